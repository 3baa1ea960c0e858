from pyspark.sql import functions as F

from siltbed.llm import language, queries

from .conftest import documents, edge_rows


def test_held_out_accuracy(spark, sf_dir):
    found = queries.op5_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    rows = found.join(docs, "doc_id").where("held_out").collect()
    long = [r for r in rows if len(r["text"]) > 100]
    assert sum(r["lang_pred"] == r["lang"] for r in long) >= 0.98 * len(long)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark):
    rows = edge_rows()
    docs = documents(spark, rows)
    found = language.identify(docs, F.lit(True), keep=docs.columns).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and not by[i]["accepted"] for i in (1, 2, 3, 9))
    assert by[4]["lang_pred"] == "en" and by[None]["lang_pred"] in ("en", "fr", "de")
    none = language.identify(docs, F.lit(False), keep=["doc_id"])
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert language.identify(docs.limit(0), F.lit(True), keep=["doc_id"]).count() == 0
    one = language.identify(docs, F.col("lang") == "fr", keep=["doc_id"])
    assert {r["lang_pred"] for r in one.collect()} == {"und", "fr"}


def test_letters_are_the_categories_l():
    assert [language.letters(x) for x in ("½ ² ①", "Ⅳ", "१२ _ ٣", "", None)] == [""] * 5
    assert language.letters("Été ½ 中文2x") == " été 中文 x "


def test_every_language_is_learned(spark):
    """70 languages of invented words, one of them with long texts alone."""
    import random

    rng = random.Random(1)
    vocabularies = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(150)] for _ in range(70)]
    rows = [(70 * k + i, " ".join(rng.choices(own, k=20_000 if i == 69 else 120)), f"l{i}", "a") for k in range(8) for i, own in enumerate(vocabularies)]
    docs = documents(spark, rows).withColumn("siltbed_text", F.lit("own"))
    found = language.identify(docs, F.col("doc_id") < 420, keep=["doc_id", "lang", "siltbed_text"]).where("doc_id >= 420").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.98 * len(found)
    assert all(r["lang_pred"] == "l69" for r in found if r["lang"] == "l69")


def test_ties_are_rejected():
    name = language.Classifier({"a": b" one two three " * 20, "b": b" one two three " * 20})
    assert name("one two three") == ("a", 0.0)


def test_a_few_words(spark):
    """Four words tell apart languages that share their letters."""
    import random

    rng = random.Random(2)
    vocabularies = {k: ["".join(rng.choices("aeiou" + letters, k=rng.randrange(3, 9))) for _ in range(300)] for k, letters in (("a", "bcdfg"), ("b", "hklmn"), ("c", "prstv"))}
    name = language.Classifier({k: (" " + " ".join(rng.choices(own, k=8000)) + " ").encode() for k, own in vocabularies.items()})
    found = [name(" ".join(rng.choices(own, k=4)))[0] == k for k, own in vocabularies.items() for _ in range(100)]
    assert sum(found) >= 0.98 * len(found)
