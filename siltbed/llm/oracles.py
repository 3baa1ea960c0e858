"""DuckDB SQL for the operators' queries that SQL can express on whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x20\x09-\x0D]+"

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM documents),
    sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    linked AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    sym AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
    reach AS (SELECT a, b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a)
    SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(r.m, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = doc_id"""


def _urls(rules: list[tuple[str, str, str]]) -> str:
    by_length = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r), reverse=True)
    case = lambda what: " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(v, h, p)}'" for v, h, p in by_length)
    return rf"""WITH a AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, url, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, coalesce(rest, '') AS rest FROM a),
    c AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path,
        regexp_replace(regexp_replace('&' || regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&(utm_[^=&]*|ref)(=[^&]*)?', '', 'g'), '^&+', '') AS query FROM b),
    d AS (SELECT *, CASE {case(lambda v, h, p: h + p)} END AS rule, CASE {case(lambda v, h, p: v)} END AS said,
        CASE WHEN host != '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '(\.html|/)$', '') || CASE WHEN query != '' THEN '?' || query ELSE '' END END AS name FROM c)
    SELECT page_id, host, path, rule, rule IS NULL AND coalesce(name IN (SELECT name FROM d WHERE page_id % 20 = 0 AND name IS NOT NULL), false) AS listed,
        coalesce(said, CASE WHEN name IN (SELECT name FROM d WHERE page_id % 20 = 0 AND name IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict FROM d"""


MIXING = rf"""WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS size,
        (CAST(('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
    s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key),
    w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY key) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
    r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio FROM w),
    k AS (SELECT *, row_number() OVER (ORDER BY ratio) AS place, coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
        sum(weight) OVER (ORDER BY ratio ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, sum(source_size) OVER () AS words FROM r),
    l AS (SELECT (CAST(words AS DOUBLE) - held) / free AS level FROM k WHERE (CAST(words AS DOUBLE) - held) / free <= ratio ORDER BY place LIMIT 1),
    t AS (SELECT key, source_size, least(weight * level, 3.0::DOUBLE * source_size) AS target FROM w, l),
    e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0 END AS x FROM d JOIN t USING (key)),
    f AS (SELECT *, CAST(floor(x) AS BIGINT) AS whole, x - floor(x) AS p FROM e),
    g AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN u / (1 - u) / (p / (1 - p)) END AS q FROM f),
    h AS (SELECT *, max(target) OVER (PARTITION BY key) - sum(whole * size) OVER (PARTITION BY key) AS lack, sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY key ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM g),
    i AS (SELECT *, CASE WHEN q IS NOT NULL AND run <= lack THEN 1 ELSE 0 END AS one FROM h),
    j AS (SELECT *, target - sum(size * (whole + one)) OVER (PARTITION BY key) AS short FROM i),
    m AS (SELECT key, arg_min(doc_id, (abs(short - size), q, doc_id)) AS doc_id, 1 AS last FROM j WHERE q IS NOT NULL AND one = 0 AND abs(short - size) < abs(short) GROUP BY key)
    SELECT j.doc_id, j.size, source_size, target, CAST(CASE WHEN j.size > 0 THEN (whole + one + coalesce(last, 0)) * j.size ELSE 0 END AS BIGINT) AS taken FROM j LEFT JOIN m ON m.key = j.key AND m.doc_id = j.doc_id"""


def oracles(rules: list[tuple[str, str, str]]) -> dict[str, str]:
    return {"op6_ngram_jaccard": JACCARD, "op8_url_filters": _urls(rules), "op10_mixing_sources": MIXING}
