"""Blocks out of recognisers' answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions.geometry import parse_box, to_pixels
from leafwork.functions.text import strip

# The form of a mark: its kind, numbers in brackets, and the text up to the next one (fixed value).
_MARK = r"(?s)<\|det\|>([a-z_]+)(?:\s*\[([0-9,\s]+)\])?<\|/det\|>(.*?)(?=<\|det\|>|\z)"


def marker_blocks(raw: Column) -> Column:
    """Blocks of marked-up text: array of (``kind``, ``box`` of 0..1000, ``text``); marks without four numbers are skipped."""
    parts = [F.regexp_extract_all(raw, F.lit(_MARK), F.lit(i)) for i in (1, 2, 3)]
    rows = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("kind", "box", "text"))])  # the aliases name the fields
    rows = F.transform(rows, lambda r: F.struct(r["kind"].alias("kind"), parse_box(r["box"]).alias("box"), r["text"].alias("text")))
    return F.filter(rows, lambda r: r["box"].isNotNull())


def json_object(raw: Column) -> Column:
    """The JSON object in an answer, as a variant: that in a fence or the whole, or from its first to its last brace; null where there is none."""
    fence = F.regexp_extract_all(raw, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1))
    t = strip(F.coalesce(F.get(fence, F.lit(0)), raw))  # what a fence holds, even if it is nothing
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(t), F.when(inner != "", F.try_parse_json(inner)))


def json_blocks(df: DataFrame, raw: str, *keep: str) -> DataFrame:
    """Blocks of JSON answers in pixels of ``width`` x ``height``; blocks without a box of four numbers are dropped."""
    v = df.select(*keep, "width", "height", F.expr(f"try_variant_get({raw}, '$.blocks', 'array<variant>')").alias("items"))
    v = v.select(*keep, "width", "height", F.posexplode("items").alias("block_index", "i"))
    get = lambda path, kind: F.expr(f"try_variant_get(i, '{path}', '{kind}')")
    box = F.array(*[get(f"$.bbox[{k}]", "double") for k in range(4)])
    kind = F.lower(F.trim(F.coalesce(get("$.kind", "string"), F.lit("text"))))
    v = v.withColumn("box", box).filter(F.forall("box", lambda x: x.isNotNull()) & (F.size(get("$.bbox", "array<variant>")) == 4))
    return v.select(*keep, "block_index", F.when(kind == "", "text").otherwise(kind).alias("kind"), to_pixels(F.col("box"), F.col("width"), F.col("height")).alias("bbox"), F.coalesce(get("$.text", "string"), F.lit("")).alias("text"))
