"""A training corpus from documents: language ID, line dedup, near duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import jaccard, language, lines, mixing, packing, queries
from siltbed.llm.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of ids up to which they are sent to the scan; more are joined by hash.
SENT = 1 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart stay, as they are; nothing is learned from a quarter of them.

    Rejected ones, those without a letter and rows without a doc_id (no later stage could refer to them) go.
    """
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    judged = language.identify(docs.where("doc_id is not null"), learn, keep=COLUMNS)
    return judged.where("accepted").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines stay in one document; documents that have no word left go, n_chars follows the text."""
    cut = lines.dedup_lines(docs.select(*COLUMNS), Scratch(spark, "lines"))
    kept = cut.where((F.col("n_dropped") == 0) | F.col("text").rlike(mixing.WORD))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words, 0.8 alike or more, the one with the smallest id stays."""
    scratch = Scratch(spark, "near")
    found = jaccard.similar_documents(docs, scratch, size=5, percent=80)
    gone = scratch.save(found.where("component_id != doc_id").select("doc_id").distinct(), "gone")
    kept = docs.join(F.broadcast(gone) if gone.count() <= SENT else gone, "doc_id", "left_anti")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times."""
    scratch = Scratch(spark, "mix")
    mixed = scratch.save(mixing.mix(docs, scratch).where("copies > 0").select("doc_id", "copies"), "copies")
    taken = docs.join(F.broadcast(mixed) if mixed.count() <= SENT else mixed, "doc_id")
    return taken.select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and copies, placed in sequences."""
    return packing.pack(docs, Scratch(spark, "pack"), tokenizer=queries.vocabulary(), capacity=queries.CAPACITY)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: SQL can express neither the compression sizes nor the tokenizer; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on documents; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, str(k))
    return docs
