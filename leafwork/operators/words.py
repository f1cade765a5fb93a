"""Words of a recogniser regrouped to lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions.text import classify, has_cjk, strip

LINE = ["block_num", "par_num", "line_num"]
SPREAD = 3 * 1.4826


def usable(words: DataFrame) -> DataFrame:
    return words.filter((strip(F.col("text")) != "") & (F.col("conf").cast("int") >= 0))


def lines(words: DataFrame, page: str = "page_id") -> DataFrame:
    """One row per line: box without outliers in height, top or bottom (beyond the median plus or minus three scaled median
    deviations), mean confidence and text of all words, class, and reading order.

    Needs ``page``, ``block_num``, ``par_num``, ``line_num``, ``word_seq``, ``left``, ``top``, ``width``, ``height``, ``text``, ``conf``.
    """
    keys = [page, *LINE]
    w = usable(words).withColumn("bottom", F.col("top") + F.col("height"))
    median = w.groupBy(keys).agg(*[F.median(c).alias(f"m_{c}") for c in ("height", "top", "bottom")])
    w = w.join(median, keys)
    spread = w.groupBy(keys).agg(*[F.median(F.abs(F.col(c) - F.col(f"m_{c}"))).alias(f"d_{c}") for c in ("height", "top", "bottom")])
    w = w.join(spread, keys)
    ok = F.lit(True)
    for c in ("height", "top", "bottom"):
        ok = ok & ((F.col(f"d_{c}") == 0) | (F.abs(F.col(c) - F.col(f"m_{c}")) <= SPREAD * F.col(f"d_{c}")))
    w = w.withColumn("ok", ok)
    w = w.withColumn("ok", F.col("ok") | ~F.max("ok").over(Window.partitionBy(*keys)))
    kept = lambda c: F.when(F.col("ok"), c)
    g = w.groupBy(keys).agg(
        F.min(kept(F.col("left"))).alias("x1"), F.min(kept(F.col("top"))).alias("y1"), F.max(kept(F.col("left") + F.col("width"))).alias("x2"), F.max(kept(F.col("bottom"))).alias("y2"),
        F.avg("conf").alias("conf"), F.avg(kept(F.col("height"))).alias("mean_height"), F.min("top").alias("all_top"), F.min("left").alias("all_left"), F.min("word_seq").alias("first"),
        F.transform(F.array_sort(F.collect_list(F.struct("word_seq", "text"))), lambda x: x["text"]).alias("parts"))
    text = F.when(has_cjk(F.array_join("parts", "")), F.array_join("parts", "")).otherwise(F.array_join("parts", " "))
    order = F.row_number().over(Window.partitionBy(page).orderBy("all_top", "all_left", "first"))
    return g.select(*keys, "x1", "y1", "x2", "y2", "conf", text.alias("text"), classify(text, F.col("mean_height")).alias("kind"), order.alias("reading_order"))
