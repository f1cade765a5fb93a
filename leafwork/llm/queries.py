"""Queries of the llm operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm.languages import identify, wrong_labels_and_stretches
from leafwork.llm.leaks import find_leaks, remove_leaks
from leafwork.llm.lookalikes import consistent_text, look_alike_classes, look_alike_pairs
from leafwork.llm.noise import find_noise, paragraphs
from leafwork.llm.packing import pack_documents
from leafwork.llm.pii import find_pii, mask_pii
from leafwork.llm.truncation import truncated
from leafwork.tables import table

#: The public tokenizer that sizes documents; the operator takes its path as an argument.
TOKENIZER = os.environ.get("LEAFWORK_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items they give away."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each item leaks: words of the stretch, how many match, offsets in the text."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without the leaked stretches."""
    return remove_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's container for each capacity."""
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_windows"), TOKENIZER)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and share of unused space for each capacity."""
    used = p6_packed(spark, sf_dir).groupBy("window_id", "container_id").agg(F.sum("tokens").alias("tokens"))
    by = used.groupBy("window_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    room = F.col("containers") * F.col("capacity_tokens")
    return by.join(table(spark, sf_dir, "pack_windows"), "window_id").select(
        "window_id", "capacity_tokens", "containers", "tokens", "fullest", (1 - F.col("tokens") / room).alias("unused"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose stored text lost its end."""
    return truncated(table(spark, sf_dir, "ocr_pages")).filter("cut").select("page_id", "block_index")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each adapter and model truncates."""
    scored = truncated(table(spark, sf_dir, "ocr_pages"))
    return scored.groupBy("adapter", "model").agg(F.count(F.lit(1)).alias("blocks"), F.count_if("cut").alias("cut_blocks"), F.avg(F.col("cut").cast("int")).alias("share"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of blocks that look the same but are stored in differing characters."""
    return look_alike_pairs(table(spark, sf_dir, "ocr_pages"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose look is stored in several ways: their class, its variants, and how many blocks each is linked to."""
    c = look_alike_classes(table(spark, sf_dir, "ocr_pages"))
    return c.select("page_id", "block_index", F.hex("look").alias("class_id"), "variants", "copies", "links")


def p2_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block's one consistent text."""
    return consistent_text(table(spark, sf_dir, "ocr_pages")).select("page_id", "block_index", "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a missing or wrong label, and blocks with sentences in another language."""
    return wrong_labels_and_stretches(identify(table(spark, sf_dir, "ocr_pages")))


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's and stretch's language with its confidence."""
    return identify(table(spark, sf_dir, "ocr_pages"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct piece of personal information of each document."""
    return find_pii(table(spark, sf_dir, "documents")).select("doc_id", "pii_kind", "pii_value").distinct()


def p8_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with typed placeholders."""
    return mask_pii(table(spark, sf_dir, "documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy blocks and the kinds of noise in them."""
    return find_noise(table(spark, sf_dir, "ocr_pages"))


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as continuous paragraphs."""
    return paragraphs(table(spark, sf_dir, "ocr_pages"))


QUERIES = {
    "p5_found": p5_found, "p5_paragraphs": p5_paragraphs,
    "p8_found": p8_found, "p8_masked": p8_masked,
    "p3_found": p3_found, "p3_languages": p3_languages,
    "p2_found": p2_found, "p2_text": p2_text, "p2_classes": p2_classes,
    "p1_found": p1_found, "p1_rates": p1_rates,
    "p7_found": p7_found, "p7_spans": p7_spans, "p7_clean": p7_clean, "p6_packed": p6_packed, "p6_fill": p6_fill}
SQL: dict[str, str] = {}
