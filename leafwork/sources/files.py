"""Files as tables: uploads with their digests, and what lies in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions.text import file_name


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """One job for each file below a folder that is not empty: ``id`` (12 hexadecimal digits), ``filename``, ``pdf_path``, ``pdf_sha256``, ``status``."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter("length > 0")
    return f.select(F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(12)).alias("id"), file_name(F.col("path")).alias("filename"), F.col("path").alias("pdf_path"), F.sha2("content", 256).alias("pdf_sha256"), F.lit("uploaded").alias("status"))


def inventory_files(spark: SparkSession, folder: str, area: str, recursive: bool) -> DataFrame:
    """What lies in a folder (``area``, ``path``, ``name``, ``is_dir``, ``size_bytes``, ``mtime``): its files and folders, or everything below it. A folder has the
    size of all files below it and the time of the newest. Contents are not read; empty files are not listed, as Spark's reader passes over them."""
    root = folder.rstrip("/")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    base = "/" + root.removeprefix("file:").lstrip("/")
    f = f.withColumn("steps", F.split(F.expr(f"substring(path, {len(base) + 2})"), "/"))
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size("steps") - 1, F.lit(1))), lambda n: F.array_join(F.slice("steps", 1, n), "/"))
    deep = f.filter(F.size("steps") > 1)
    above = deep.select(F.explode(up if recursive else F.slice("steps", 1, 1)).alias("rel"), "size_bytes", "mtime").groupBy("rel").agg(F.sum("size_bytes").alias("size_bytes"), F.max("mtime").alias("mtime"))
    folders = above.select(F.concat(F.lit(base + "/"), "rel").alias("path"), F.lit(True).alias("is_dir"), "size_bytes", "mtime")
    own = (f if recursive else f.filter(F.size("steps") == 1)).select("path", F.lit(False).alias("is_dir"), "size_bytes", "mtime")
    return own.unionByName(folders).select(F.lit(area).alias("area"), "path", file_name(F.col("path")).alias("name"), "is_dir", "size_bytes", "mtime")
