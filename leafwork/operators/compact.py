"""Few well-sized files out of very many small ones.

``compact_parquet`` merges Parquet files by copying their encoded column blocks. ``consolidate_cache`` is the whole way for a page
cache of one record a file: records are keyed, equal ones kept once, written in blocks, and the blocks merged.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwork.shared import delete, scratch, stage
from leafwork.sources.parquet_blocks import merge

TARGET_BYTES, SPREAD = 128 << 20, 4096
#: Members of a record that are paired in one piece; larger groups are salted.
SALT_ROWS = 2000
MANIFEST = "out_file string, source_files long, source_bytes long, rows long, blocks long, bytes long"

#: What a block field that is left out stands for.
BLOCK_DEFAULTS = {"caption": "", "conf": None, "font_scale": Decimal(1)}


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + re.sub(r"^file:", "", uri))


def _uri(path: str) -> str:
    """Spark names local files ``file:/a``; other libraries want ``file:///a``."""
    return re.sub(r"^file:/+", "file:///", path)


def compact_parquet(spark: SparkSession, folder: str, out: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Merge the Parquet files below ``folder`` into files of about ``target_bytes`` in ``out``; returns the manifest.

    Files are put in groups of at most ``target_bytes`` by the running sum of their sizes (within ``SPREAD`` parts, so no task orders all of
    them); a larger file is a group by itself. Each group is one task that copies blocks one after the other, so neither the driver
    nor a task holds the data. Before anything is returned, the manifest is held against the listing (files) and against an own count of the
    rows, taken by reading the outputs' footers through Spark; a difference makes the call fail. An empty folder gives an empty
    manifest. Files of unlike schema make the call fail rather than lose rows.
    """
    files = stage(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path", "length"), "files")
    listed = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = max(1, min(SPREAD, -(-listed[1] // (16 * target_bytes))))
    spark._jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(out))

    def work(key, pdf):
        import pandas as pd

        paths = [_uri(p) for p in sorted(pdf["path"])]
        fs, _ = _filesystem(paths[0])
        name = f"{_uri(out)}/merged-{int(key[0]):05d}-{int(key[1]):06d}.parquet"
        return pd.DataFrame([{"out_file": name, "source_files": len(paths), "source_bytes": int(pdf["length"].sum()), **merge(fs, [_filesystem(p)[1] for p in paths], _filesystem(name)[1])}])

    order = Window.partitionBy("part").orderBy("length", "path")
    grouped = files.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int")).withColumn("grp", F.floor((F.sum("length").over(order) - 1) / target_bytes))
    manifest = stage(grouped.groupBy("part", "grp").applyInPandas(work, MANIFEST), "manifest")
    merged = manifest.agg(F.coalesce(F.sum("source_files"), F.lit(0)), F.coalesce(F.sum("source_bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    rows = spark.read.parquet(out).count() if listed[0] else 0
    if (merged[0], merged[1], merged[2]) != (listed[0], listed[1], rows):
        raise ValueError(f"{merged[0]} files of {merged[1]} bytes and {merged[2]} rows were merged, not {listed[0]} of {listed[1]} and {rows}")
    return manifest


def normal_key(key: str | None) -> str | None:
    """The 64 hexadecimal digits of a cache key however it is written (case, prefix, folder, extension, separators); else None."""
    if key is None:
        return None
    base = re.sub(r"\.json.*$", "", re.split(r"[/\\]", key.strip().lower())[-1])
    digits = re.sub(r"[\s:_-]", "", re.sub(r"^(0x|sha-?256[:=])", "", base))
    return digits if re.fullmatch(r"[0-9a-f]{64}", digits) else None


def _no_constant(name: str):
    raise ValueError(name)


def _plain(x):
    """Numbers by value: 1, 1.0 and 10e-1 are one; strings, null and booleans stay apart from them."""
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    if isinstance(x, Decimal):
        n = x.normalize()
        return {"#": "0" if n == 0 else str(n)}
    return x


def normal_page(page: str | None) -> str | None:
    """A page's canonical JSON text, the same for equal JSON values; None for what is not a readable JSON object.

    Object order, white space, escapes and number formats don't matter; a block's ``caption``, ``conf`` and ``font_scale`` take
    their default where left out.
    """
    if not page:
        return None
    try:
        value = json.loads(page, parse_int=Decimal, parse_float=Decimal, parse_constant=_no_constant)
    except (ValueError, RecursionError, InvalidOperation):
        return None
    if not isinstance(value, dict):
        return None
    if isinstance(value.get("blocks"), list):
        value["blocks"] = [BLOCK_DEFAULTS | b if isinstance(b, dict) else b for b in value["blocks"]]
    try:
        return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


def _fingerprint(key: str | None, page: str | None) -> str | None:
    k = normal_key(key)
    p = normal_page(page) if k else None
    return hashlib.blake2b(f"{k}\n{p}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if p is not None else None


def keyed(files: DataFrame, carry: list[str]) -> DataFrame:
    """(``fp``, ``file_id``, ``carry``...) of each readable record; equal records have equal ``fp``."""
    fields = ["file_id", *carry]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_fingerprint(k, p) for k, p in zip(b.column("key").to_pylist(), b.column("page").to_pylist())]
            keep = pa.array([x is not None for x in fps])
            out = [pa.array(fps, pa.string()).filter(keep), *(b.column(c).filter(keep) for c in fields)]
            yield pa.RecordBatch.from_arrays(out, ["fp", *fields])

    source = files.select(*dict.fromkeys(["file_id", "key", "page", *carry]))
    kinds = dict(source.dtypes)
    return source.mapInArrow(work, "fp string, " + ", ".join(f"{c} {kinds[c]}" for c in fields))


class Consolidated:
    """The result of ``consolidate_cache``: ``records`` (each once), ``members`` (every file's record) and a manifest of each."""

    def __init__(self, records: DataFrame, members: DataFrame, manifest: DataFrame):
        self.records, self.members, self.manifest = records, members, manifest


def _write_merged(df: DataFrame, name: str, target_bytes: int) -> tuple[DataFrame, DataFrame]:
    spark = df.sparkSession
    parts, out = scratch(spark, name + "-parts"), scratch(spark, name)
    df.write.parquet(parts)
    manifest = compact_parquet(spark, parts, out, target_bytes)
    delete(spark, parts)
    return spark.read.schema(df.schema).parquet(out), manifest.withColumn("dataset", F.lit(name))


def consolidate_cache(files: DataFrame, target_bytes: int = TARGET_BYTES, with_records: bool = True) -> Consolidated:
    """Every record of a cache of tiny files once, in few files.

    ``files`` has ``file_id``, ``key``, ``page``; further columns of the table are ignored. A record is a 64-digit key with a page
    that is a readable JSON object; rows without either (null, empty, cut-off, other JSON) are no records. Of equal records the
    smallest ``file_id`` is kept with its text as stored; same key with another page is another record. A hot record is reduced
    on the map side before the shuffle. Repeated rows of one ``file_id`` count once.
    """
    prints = stage(keyed(files, []).select("file_id", "fp"), "prints")
    members, m_manifest = _write_merged(prints, "members", target_bytes)
    if not with_records:
        return Consolidated(members, members, m_manifest)
    # the kept file of each record is chosen among fingerprints only; its text is fetched by a join and not carried through an aggregation
    kept = prints.groupBy("fp").agg(F.min("file_id").alias("file_id"))
    texts = files.select("file_id", "key", "page").join(kept, "file_id").groupBy("file_id", "fp").agg(F.any_value(F.struct("key", "page")).alias("r"))
    records, manifest = _write_merged(texts.select("file_id", "fp", "r.key", "r.page"), "records", target_bytes)
    if records.count() != kept.count():
        raise ValueError("records were lost or kept twice")
    return Consolidated(records, members, manifest.unionByName(m_manifest))


def record_members(done: Consolidated) -> DataFrame:
    """Every file's record by its kept file: ``file_id``, ``record`` (the smallest ``file_id`` with it), ``links`` (files with the same record beside it)."""
    m = done.members.distinct()
    g = m.groupBy("fp").agg(F.min("file_id").alias("record"), (F.count(F.lit(1)) - 1).alias("links"))
    return m.join(g, "fp").select("file_id", "record", "links")


def same_record_pairs(done: Consolidated) -> DataFrame:
    """(``file_id_a``, ``file_id_b``), smaller first, of files with the same record. A record in very many files is cut into salts of ``SALT_ROWS``
    files, each of which meets all of them in tasks of its own."""
    members = done.members.distinct()
    shared = members.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))
    twice = members.join(shared, "fp")
    a = twice.select("fp", F.pmod(F.xxhash64("file_id"), F.col("salts")).cast("int").alias("salt"), F.col("file_id").alias("file_id_a"))
    b = twice.select("fp", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("file_id").alias("file_id_b"))
    return a.join(b, ["fp", "salt"]).filter("file_id_a < file_id_b").select("file_id_a", "file_id_b")
