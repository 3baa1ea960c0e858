"""URL rules and a block list behind a blocked Bloom filter, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8  # 64-bit words of a block; a key sets one bit in each
BITS = 16  # bits of the filter for each listed URL
#: Bytes up to which the filter's blocks or the list are sent to every executor.
SENT = 8 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where `://` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.coalesce(F.regexp_extract(after, r"^[^?#]*", 0), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def canonical(url: Column) -> Column:
    """Host without `www.`, path without `.html` or `/` at its end, and query without `utm_` and `ref`
    parameters; the scheme and the fragment go. Null where there is no host."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), query), r"&(utm_[^=&]*|ref)(=[^&]*)?", ""), "^&+", "")
    name = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(\.html|/)$", ""))
    return F.when(host != "", F.when(query != "", F.concat(name, F.lit("?"), query)).otherwise(name))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules: (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _masks(key: str) -> list[Column]:
    bits = F.xxhash64(F.lit("bits"), F.col(key))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def blocked_bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w7): the filter's blocks that have bits."""
    rows = listed.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks(key))))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def possible(rows: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key may be listed: all that are, and few others."""
    small = blocks * 8 * (WORDS + 1) <= SENT
    probe = rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    hit = F.lit(True)
    for i, m in enumerate(_masks(key)):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) != 0)
    return probe.join(F.broadcast(bloom) if small else bloom, "block").where(hit).drop("block", *(f"w{i}" for i in range(WORDS)))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], *, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, listed, verdict of each page.

    The longest fitting rule decides. Else a page is blocked if its canonical URL is that of a row of
    `listed` (column url): its distinct canonical URLs fill a blocked Bloom filter, pages that pass it
    go to an exact hash join with the list, and only matches there are blocked. The filter's blocks and the
    list are broadcast if under SENT bytes by their count, else joined by hash.

    Null URLs, or those without `://`, have empty host and path, fit no rule and are not listed. Rows with equal ids are
    judged one by one. Listed nulls and repeats count for nothing; an empty list blocks nothing.
    Columns other than page_id and url are not read. `rules` are code, a handful of literals.
    """
    host, path = host_and_path(F.col("url"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("said", verdict)
    names = listed.select(canonical(F.col("url")).alias("name")).where("name is not null").distinct()
    facts = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("name") + 16), F.lit(0)).alias("size")).first()
    blocks = max(1, -(-facts["n"] * BITS // (64 * WORDS)))
    open_ = judged.withColumn("name", F.when(F.col("rule").isNull(), canonical(F.col("url"))))
    asked = open_.where("name is not null").select("name").distinct()
    # The exact join is an inner one, as the optimizer moves a semi join below the filter.
    maybe = possible(asked, "name", blocked_bloom(names, "name", blocks), blocks)
    hits = maybe.join(F.broadcast(names) if facts["size"] <= SENT else names.hint("shuffle_hash"), "name").withColumn("hit", F.lit(True))
    # A key of its own for each page that isn't asked for, so that nulls don't meet in one task.
    out = open_.withColumn("name", F.coalesce("name", F.concat(F.lit(" "), F.col("page_id").cast("string"), F.lit(" "), F.col("host")))).join(hits, "name", "left")
    listed_ = F.coalesce("hit", F.lit(False))
    return out.select("page_id", "host", "path", "rule", listed_.alias("listed"), F.coalesce("said", F.when(listed_, "block").otherwise(default)).alias("verdict"))
