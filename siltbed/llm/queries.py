"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, html, jaccard, language, lines, mixing, oracles, packing, passages, quality, urls
from .scratch import Scratch

#: Rules of the URL query: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
CAPACITY = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The packing queries' tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without recurring lines, n_lines, n_dropped of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, Scratch(spark, "op1"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage of 50 words or more that an earlier document has too."""
    return passages.near_passages(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), Scratch(spark, "op3"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    return language.identify(docs, ~held_out, keep=["doc_id", "held_out"])


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar_documents(table(spark, sf_dir, "documents"), Scratch(spark, "op6"), size=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), Scratch(spark, "op7"), tokenizer=vocabulary(), capacity=CAPACITY)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table lists blocked URLs: those of pages whose id is divisible by 20 stand in for a list that grows with the corpus."""
    pages = table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, pages.where("page_id % 20 = 0").select("url"), RULES)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op9"))


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_substring_dedup, op3_html_extraction, op4_document_fingerprints, op5_language_id, op6_ngram_jaccard, op7_best_fit_packing, op8_url_filters, op9_quality_rules, op10_mixing_sources)
}

ORACLES: dict[str, str] = oracles.oracles(RULES)
