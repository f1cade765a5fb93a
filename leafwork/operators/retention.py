"""What is stored, what is referenced, and what may go. Nothing is deleted here: the operators report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLEANUP_HOURS, CACHE_HOURS = 168.0, 720.0


def age_hours(mtime: Column, now: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(mtime.cast("timestamp"))) / 3.6e9), 2)


def referenced_paths(jobs: DataFrame) -> DataFrame:
    paths = F.array("pdf_path", "img_dir", "embedded_path", "thumb_path")
    return jobs.select(F.explode(paths).alias("path")).filter("path is not null").distinct()


def inventory(files: DataFrame, referenced: DataFrame, now: Column, limit: float = CLEANUP_HOURS) -> DataFrame:
    """Per area and (area null) in all: files and bytes not referenced, those old enough to go, and referenced files.

    ``files`` needs ``area``, ``path``, ``size_bytes``, ``mtime``.
    """
    f = files.join(referenced.select("path", F.lit(True).alias("ref")), "path", "left").withColumn("ref", F.coalesce("ref", F.lit(False)))
    f = f.withColumn("ready", ~F.col("ref") & (age_hours(F.col("mtime"), now) >= limit))
    return f.rollup("area").agg(
        F.count_if(~F.col("ref")).alias("unreferenced"), F.sum(F.when(~F.col("ref"), F.col("size_bytes")).otherwise(0)).alias("unreferenced_bytes"), F.count_if("ready").alias("ready"),
        F.sum(F.when(F.col("ready"), F.col("size_bytes")).otherwise(0)).alias("ready_bytes"), F.count_if("ref").alias("referenced"))


def cleanup_plan(files: DataFrame, referenced: DataFrame, now: Column, limit: float = CLEANUP_HOURS, force: bool = False) -> DataFrame:
    """What a cleanup would do: files deleted and bytes freed, kept as referenced, kept as too fresh. ``force`` relaxes the age, never the references."""
    f = files.join(referenced.select("path", F.lit(True).alias("ref")), "path", "left").withColumn("ref", F.coalesce("ref", F.lit(False)))
    old = F.lit(True) if force else age_hours(F.col("mtime"), now) >= limit
    gone = ~F.col("ref") & old
    return f.agg(F.count_if(gone).alias("deleted"), F.coalesce(F.sum(F.when(gone, F.col("size_bytes"))), F.lit(0)).alias("freed_bytes"), F.count_if("ref").alias("kept_referenced"), F.count_if(~F.col("ref") & ~old).alias("kept_fresh"))


def expired(mtime: Column, now: Column, hours: float = CACHE_HOURS) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(mtime.cast("timestamp"))) / 3.6e9 > hours


def cache_stats(cache: DataFrame, now: Column, hours: float = CACHE_HOURS) -> DataFrame:
    gone = expired(F.col("mtime"), now, hours)
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.sum("size_bytes").alias("bytes"), F.count_if(gone).alias("expired"), F.coalesce(F.sum(F.when(gone, F.col("size_bytes"))), F.lit(0)).alias("expired_bytes"))


def lookup(requests: DataFrame, cache: DataFrame, now: Column, hours: float = CACHE_HOURS) -> DataFrame:
    """Hits and misses of requested keys: a hit is the newest entry of a key, neither expired nor without a page."""
    newest = cache.groupBy("key").agg(F.max(F.struct("mtime", "file_id", (F.coalesce("page", F.lit("")) != "").alias("has_page"))).alias("e")).select("key", "e.*")
    live = newest.filter(~expired(F.col("mtime"), now, hours) & F.col("has_page")).select("key", "file_id")
    return requests.join(live, "key", "left").withColumn("hit", F.col("file_id").isNotNull())


def oldest_first(files: DataFrame, referenced: DataFrame, now: Column) -> DataFrame:
    """Files that nothing refers to with their age in hours, oldest first."""
    f = files.join(referenced.select("path"), "path", "left_anti").withColumn("age_hours", age_hours(F.col("mtime"), now))
    return f.orderBy(F.desc("age_hours"), "path")


def upsert(cache: DataFrame, new: DataFrame, enabled: bool = True) -> DataFrame:
    """A cache with further entries of its columns appended; which of a key's entries counts is decided on reading, the newest one."""
    return cache.unionByName(new.select(*cache.columns)) if enabled else cache


def context_key(**fields: Column) -> Column:
    """The 64-digit key of a context: SHA-256 of its JSON with fields in the order of their names and nulls kept, so that unlike contexts differ."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())]), {"ignoreNullFields": "false"}), 256)
