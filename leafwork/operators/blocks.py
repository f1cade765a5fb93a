"""Pages as rows of blocks, and what is asked of them: confidence, review, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions.text import strip

PICTURES = ("image", "image_ref")


def flat(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per block with its 0-based ``block_index``; pages without blocks give none."""
    return pages.select("page_id", *keep, F.posexplode("blocks").alias("block_index", "b")).select("page_id", *keep, "block_index", "b.*")


def embeddable(kind: Column, text: Column) -> Column:
    return ~kind.isin(*PICTURES) & text.isNotNull() & (strip(text) != "")


def percent(conf: Column) -> Column:
    """Confidence of either scale in per cent; null where it is no finite number."""
    ok = conf.isNotNull() & ~F.isnan(conf) & (F.abs(conf) < float("inf"))
    return F.when(ok, F.when(conf > 1, conf).otherwise(conf * 100))


def confidence_class(pct: Column) -> Column:
    return F.when(pct.isNull(), "na").when(pct >= 85, "high").when(pct >= 60, "med").otherwise("low")


def low_confidence(pages: DataFrame, threshold: float = 60) -> DataFrame:
    """Blocks below the threshold and whether there is any confidence, per page; arrays are counted in place, without a shuffle."""
    pct = F.transform("blocks", lambda b: percent(b["conf"]))
    return pages.select("page_id", "job_id", F.coalesce(F.size(F.filter(pct, lambda p: p < threshold)), F.lit(0)).alias("low"), F.coalesce(F.exists(pct, lambda p: p.isNotNull()), F.lit(False)).alias("has_conf"))


def edit_block(pages: DataFrame, index: int, text: str | None = None, font_scale: float | None = None) -> DataFrame:
    """A block's text or size gain (0.5 to 1.5) changed by its place; pages without that block stay as they are."""

    def changed(b):
        b = b if text is None else b.withField("text", F.lit(text))
        return b if font_scale is None else b.withField("font_scale", F.lit(max(0.5, min(1.5, float(font_scale)))))

    return pages.withColumn("blocks", F.transform("blocks", lambda b, i: F.when(i == index, changed(b)).otherwise(b)))


def delete_block(pages: DataFrame, index: int) -> DataFrame:
    return pages.withColumn("blocks", F.filter("blocks", lambda b, i: i != index))


def compact_json(pages: DataFrame) -> DataFrame:
    """Pages as JSON with what equals its default left out."""
    slim = F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["bbox"].alias("bbox"), F.coalesce(b["text"], F.lit("")).alias("text"), F.nullif(b["caption"], F.lit("")).alias("caption"), b["conf"].alias("conf"), F.nullif(b["font_scale"], F.lit(1.0)).alias("font_scale")))
    return pages.select("page_id", F.to_json(F.struct("page_index", "width", "height", slim.alias("blocks"))).alias("page"))


def latest_pages(pages: DataFrame) -> DataFrame:
    """The last version of each page of a job: largest (``ingested_at``, ``page_id``), reduced before the shuffle."""
    return pages.groupBy("job_id", "page_index").agg(F.max(F.struct("ingested_at", "page_id")).alias("v")).select("job_id", "page_index", "v.page_id")


def pair_captions(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Images with the caption that follows: of rows with ``role`` pending, caption or other, a caption takes the pending image right
    before it (others between them do not count), alone it becomes image_caption; a pending image stays only as the last."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.filter(F.col("role").isin("pending", "caption")).select("*", F.lag("role").over(w).alias("was"), F.lag(order).over(w).alias("image_at"), F.lead("role").over(w).alias("next"))
    taken = (F.col("role") == "caption") & (F.col("was") == "pending")
    out = F.when(taken, "image").when(F.col("role") == "caption", "image_caption").when(F.col("next").isNull(), "image")
    return marked.select(*keys, order, out.alias("kind"), F.when(taken, F.col("image_at")).alias("image_at")).filter("kind is not null")
