from pyspark.sql import functions as F

from siltbed.llm import queries, urls


def judge(spark, names, listed, rules=queries.RULES):
    pages = spark.createDataFrame(list(enumerate(names)), "page_id long, url string").select("*", F.lit(1).alias("host"), F.lit(2).alias("name"), F.lit(3).alias("block"))
    return {r["page_id"]: r for r in urls.judge_urls(pages, spark.createDataFrame([(x,) for x in listed], "url string"), rules).collect()}


def test_rules(spark):
    names = ["http://A.ORG/x?q#f", "https://example.org/es/1", "https://www.example.org/en/12", "https://notexample.org/es/", "http://x.com/fr/1", "http://com/de/", "http://x.com/de", None, "nonsense", "http://a.org", "://x.com/fr/", "http://x.net/a"]
    found = judge(spark, names, [])
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for _, r in sorted(found.items())]
    assert got == [
        ("a.org", "/x", "org/", "allow"),
        ("example.org", "/es/1", "example.org/es/", "block"),
        ("www.example.org", "/en/12", "example.org/en/1", "block"),
        ("notexample.org", "/es/", "org/", "allow"),
        ("x.com", "/fr/1", "com/fr/", "allow"),
        ("com", "/de/", "com/de/", "block"),
        ("x.com", "/de", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("a.org", "", None, "allow"),
        ("x.com", "/fr/", "com/fr/", "allow"),
        ("x.net", "/a", None, "allow"),
    ]


def test_list_and_filter(spark, monkeypatch):
    names = [f"http://www.h{i % 50}.net/p/{i}.html?utm_source=x&a={i % 3}#t" for i in range(2000)]
    listed = [f"https://h{i % 50}.net/p/{i}/?a={i % 3}" for i in range(0, 2000, 7)] + [None, "x", "http://gone.net/"]
    for sent in (8 << 20, 0):
        monkeypatch.setattr(urls, "SENT", sent)
        found = judge(spark, names, listed)
        assert len(found) == 2000 and all((found[i]["verdict"] == "block") == (i % 7 == 0) for i in found)


def test_bloom_passes_all_listed_and_few_others(spark):
    own = spark.range(4000).select(F.concat(F.lit("u"), F.col("id")).alias("k"))
    blocks = 4000 * urls.BITS // 512
    bloom = urls.blocked_bloom(own.where("cast(substring(k, 2) as int) < 1000"), "k", blocks // 4)
    passed = {int(r["k"][1:]) for r in urls.possible(own, "k", bloom, blocks // 4).collect()}
    assert set(range(1000)) <= passed and len(passed) < 1100


def test_empty(spark):
    assert judge(spark, [], ["http://a.net/"]) == {}
