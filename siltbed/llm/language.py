"""Language identification by compression with a dictionary for each language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import set_batches

UNKNOWN = "und"
#: Letters of a text that are compressed at once, and characters of a text that are learned from.
BLOCK = 4096
#: Windows, evenly spaced over a longer text, that make up what is learned from it.
WINDOWS = 8
#: Bytes of letters under which a text is compressed with near dictionaries, and its words once more by themselves.
SHORT = 400
#: Near dictionaries of a language, slices of its dictionary, and their bytes at most: matches of three bytes pay there.
SLICES, NEAR = 8, 1 << 13
#: Put before a short text, so that it is worth a compressed block and its size is not that of raw bytes.
PAD = b" " * 64
#: Runs of characters outside of the Unicode categories L*.
_NO_LETTER = regex.compile(r"\P{L}+")


def letters(text: str | None) -> str:
    """Lower-cased runs of letters, a space around each; empty without a letter."""
    plain = _NO_LETTER.sub(" ", text or "").strip().lower()
    return f" {plain} " if plain else ""


def fit(docs: DataFrame, learn: Column, *, dictionary: int, samples: int, total: int) -> dict[str, bytes]:
    """Raw content of each language's dictionary, from rows where `learn` holds; the most frequent language first.

    About `samples` texts of each language are taken by a hash of doc_id, all of a language that has fewer, and of each text
    BLOCK characters in windows over the whole of it. A dictionary has at most `dictionary` bytes, all together `total`.
    Every value of lang is learned; counts come from all rows.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()  # a row for each language
    if not counts:
        return {}
    size = max(1024, min(dictionary, total // len(counts)))
    samples = max(1, min(samples, samples * size // dictionary))
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, samples / r["n"])) for r in counts], "siltbed_lang string, siltbed_rate double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    width = BLOCK // WINDOWS
    step = (F.length("text") - width) / (WINDOWS - 1)
    cut = F.concat_ws(" ", *(F.substring("text", (step * i).cast("int") + 1, F.lit(width)) for i in range(WINDOWS)))
    some = F.when(F.length("text") <= BLOCK, F.col("text")).otherwise(cut)
    drawn = rows.select("lang", "text", draw.alias("siltbed_draw")).join(F.broadcast(rates), F.col("lang") == F.col("siltbed_lang")).where("siltbed_draw < siltbed_rate")
    found = drawn.select("lang", some.alias("text"), F.col("siltbed_draw").alias("h")).toPandas().sort_values(["lang", "h", "text"])
    made = {lang: b"".join(letters(x).encode() for x in own)[:size] for lang, own in found.groupby("lang")["text"]}
    return {r["lang"]: made[r["lang"]] for r in counts if made.get(r["lang"])}


class Classifier:
    """Sizes of texts under each language's dictionary; the smallest names the language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        def coder(content: bytes, **options: int):  # noqa: ANN202
            own = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            options = z.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **options)
            own.precompute_compress(compression_params=options)
            return z.ZstdCompressor(dict_data=own, compression_params=options).compress

        self.names, self.coders, self.near = list(dictionaries), [], []
        for content in dictionaries.values():
            log = 16 if len(content) > 1 << 14 else 12
            self.coders.append([coder(content, strategy=z.STRATEGY_GREEDY, min_match=4, window_log=18, hash_log=log, chain_log=log, search_log=4)])
            size = max(1, min(NEAR, -(-len(content) // SLICES)))
            self.near.append([coder(content[i : i + size], strategy=z.STRATEGY_BTOPT, min_match=3, window_log=15, hash_log=12, chain_log=12, search_log=4) for i in range(0, size * SLICES, size) if len(content) > i])

    def __call__(self, text: str | None) -> tuple[str, float]:
        plain = letters(text).encode()
        if not plain or not self.names:
            return UNKNOWN, 0.0
        if len(self.names) == 1:
            return self.names[0], 1.0
        if len(plain) < SHORT:
            # Few bytes tell a short text apart: its words count once more, each by itself.
            coders, parts = self.near, [PAD + plain, *(PAD + b" " + x + b" " for x in plain.split())]
        else:
            coders, parts = self.coders, [plain[i : i + BLOCK] for i in range(0, len(plain), BLOCK)]
        # A language of few slices counts as if it had all.
        sizes = sorted(((sum(len(code(x)) for x in parts for code in own) / len(own), name) for own, name in zip(coders, self.names, strict=True)), key=lambda s: s[0])
        return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def identify(docs: DataFrame, learn: Column, *, keep: list[str], least_margin: float = 0.002, dictionary: int = 1 << 17, samples: int = 200, total: int = 1 << 24) -> DataFrame:
    """The columns `keep` of each document, then lang_pred, score, accepted.

    The whole text's letters are compressed in blocks of BLOCK bytes with a raw-content dictionary
    of each language (those of a short text, and its words, with SLICES small ones), and the smallest sum names the language; score is the margin, the share of
    the second smallest sum that the smallest one saves. A margin under least_margin is rejected
    (accepted false), as is a text that is null or has no letter (of the Unicode categories L*), `und` with score 0.
    A tie has score 0 and names the more frequent language. With one learned language every text with a letter is that, score 1; with none, all are `und`.
    Only lang and text of rows where `learn` holds are learned from (see fit() for bounds); no other
    column takes part. Rows with equal ids are judged one by one; own columns named as the added ones are replaced.
    """
    set_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(fit(docs, learn, dictionary=dictionary, samples=samples, total=total))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = Classifier(table.value)
        for batch in batches:
            found = [name(x) for x in W.column_of(batch, "siltbed_text").to_pylist()]
            own = [c for c in batch.schema.names if c != "siltbed_text"]
            columns = [W.column_of(batch, c) for c in own]
            margin = [m for _, m in found]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for n, _ in found], pa.string()), pa.array(margin, pa.float64()), pa.array([n != UNKNOWN and m >= least_margin for n, m in found], pa.bool_())], names=[*own, "lang_pred", "score", "accepted"])

    clash = [c for c in keep if c in ("lang_pred", "score", "accepted", "siltbed_text")]
    kept = docs.select(*(c for c in keep if c not in clash))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double, accepted boolean"
    return docs.select(*kept.columns, F.col("text").cast("string").alias("siltbed_text")).mapInArrow(W.lean(judge), schema)
