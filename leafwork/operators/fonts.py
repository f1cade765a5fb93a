"""Fonts as a small table: which file is there, what it measures, which one a name means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_existing(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Of each ``name``'s (``rank``, ``path``) the first whose path exists; names without one are left out."""
    return candidates.join(existing.select("path").distinct(), "path", "left_semi").groupBy("name").agg(F.min_by("path", "rank").alias("path"))


def resource_name(number: Column) -> Column:
    """UFont and two letters that count."""
    letter = lambda n: F.char(F.lit(65) + n % 26)
    return F.concat(F.lit("UFont"), letter(F.floor(number / 26)), letter(number))


def ink(ascender: Column, descender: Column) -> Column:
    """Height of a font's ink and its rise above the baseline, per em: shares of the ascent and descent within bounds, to three places.
    A missing or zero ascender counts as 1, a descender as -0.2."""
    up = F.coalesce(F.nullif(ascender, F.lit(0.0)), F.lit(1.0))
    down = F.coalesce(F.nullif(descender, F.lit(0.0)), F.lit(-0.2))
    height = F.greatest(F.lit(0.6), F.least(F.lit(1.0), F.greatest(up - down, F.lit(0.5)) * 0.80))
    return F.struct(F.round(height, 3).alias("ink_fraction"), F.round(F.greatest(F.lit(0.6), F.least(up, up * 0.88)), 3).alias("ink_up"))


def resolve(asked: DataFrame, registry: DataFrame, existing: DataFrame) -> DataFrame:
    """The font each ``asked`` name or path means: a path that exists, else a name whatever its case, else the registry's first.

    ``registry`` (a few fonts, checked to be under 1,000) has ``rank``, ``name``, ``path``."""
    if registry.limit(1001).count() > 1000:
        raise ValueError("more than 1000 fonts")
    key = F.trim("asked")
    by_path = asked.select("asked").distinct().filter(key.startswith("/") | key.rlike(r"\.(ttf|otf|ttc)$")).join(existing.select(F.col("path").alias("found")).distinct(), key == F.col("found")).select("asked", "found")
    by_name = registry.groupBy(F.lower("name").alias("low")).agg(F.min_by(F.struct("name", "path"), "rank").alias("named"))
    first = registry.agg(F.min_by(F.struct("name", "path"), "rank").alias("first"))
    a = asked.join(by_path, "asked", "left").join(F.broadcast(by_name), F.lower(key) == F.col("low"), "left").join(F.broadcast(first))
    own = F.when(F.col("found").isNotNull(), F.struct(F.regexp_extract("found", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), F.col("found").alias("path")))
    return a.select("asked", F.coalesce(own, "named", "first").alias("font")).select("asked", "font.name", "font.path")
