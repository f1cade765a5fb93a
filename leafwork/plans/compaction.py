"""Queries of the small-file consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.operators.compact import consolidate_cache, record_members, same_record_pairs
from leafwork.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files with the same record, from the consolidated files' membership."""
    return same_record_pairs(consolidate_cache(table(spark, sf_dir, "cache_files")))


def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with the file its record is kept from, and how many others hold the same."""
    return record_members(consolidate_cache(table(spark, sf_dir, "cache_files")))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record once, read back from the consolidated files."""
    return consolidate_cache(table(spark, sf_dir, "cache_files")).records.select("file_id", "key", "page")


def p4_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was merged: files in and out, rows, column blocks, bytes."""
    m = consolidate_cache(table(spark, sf_dir, "cache_files")).manifest
    return m.groupBy("dataset").agg(
        F.sum("source_files").alias("source_files"), F.count(F.lit(1)).alias("out_files"), F.sum("rows").alias("rows"),
        F.sum("blocks").alias("blocks"), F.sum("bytes").alias("bytes"))


QUERIES = {"p4_found": p4_found, "p4_members": p4_members, "p4_records": p4_records, "p4_manifest": p4_manifest}
SQL: dict[str, str] = {}
