"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

from ..functions.hashing import BASE, FNV_MASK, FNV_OFFSET, FNV_PRIME
from ..sources import generator
from . import queries as Q

LOG = "log AS (SELECT CAST(user_id AS VARCHAR) AS k, value AS v, epoch_us(ts) AS ts_us, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS tomb, event_id + 1 AS lsn FROM events)"
NEWEST = "state AS (SELECT k, arg_max(v, (ts_us, lsn)) AS v, max(ts_us) AS ts_us, arg_max(tomb, (ts_us, lsn)) AS tomb FROM log GROUP BY k)"
PARTS = "kv AS (SELECT p_name AS k, max(p_partkey) AS v FROM part GROUP BY p_name)"
GENERATIONS = "gen AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS generation FROM (SELECT DISTINCT o_orderkey FROM orders))"
RUNS = f"{GENERATIONS}, runs AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, generation FROM gen)"


def _crc_table() -> str:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(str(n))
    return ", ".join(out)


def crc32(text: str) -> str:
    """CRC-32 of ASCII text."""
    codes = f"list_transform(range(CAST(length({text}) AS BIGINT)), lambda i: CAST(ascii(substr({text}, i + 1, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: xor(a >> 8, crc.t[CAST(xor(a & 255, b) AS BIGINT) + 1])), 4294967295::BIGINT)"


CRC = f"crc AS (SELECT CAST([{_crc_table()}] AS BIGINT[]) AS t)"


def seed(i: str) -> str:
    return f"unhex(lpad(lower(to_hex({BASE} + {i})), 8, '0') || repeat('00', 28))"


def digest(text: str, i: str) -> str:
    return f"md5({text}::BLOB || {seed(i)})"


def position(text: str, i: str, m: str) -> str:
    return f"('0x' || substr({digest(text, i)}, 9, 8))::BIGINT % {m}"


def cell(text: str, i: str) -> str:
    return f"CAST(('0x' || substr({digest(text, i)}, 1, 16))::UBIGINT % {Q.CMS_M} AS BIGINT)"


def letters(what: str, length: int) -> str:
    """Letters of the generator's words, by the bytes of a digest."""
    return " || ".join(f"substr('{generator.LETTERS}', CAST(('0x' || substr(md5('42:{what}:' || id), {2 * j + 1}, 2)) AS BIGINT) % 52 + 1, 1)" for j in range(length))


def fnv1(text: str) -> str:
    codes = f"list_transform(range(CAST(length({text}) AS BIGINT)), lambda i: CAST(ascii(substr({text}, i + 1, 1)) AS HUGEINT))"
    return f"CAST(list_reduce(list_prepend({FNV_OFFSET}::HUGEINT, {codes}), lambda a, b: xor((a * {FNV_PRIME}) & {FNV_MASK}, b)) AS BIGINT)"


def values(rows: list) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)


BITS = "CAST(ceil({n} * abs(ln(0.1)) / pow(ln(2.0), 2)) AS BIGINT)"
COUNT = "CAST(ceil({m} / {n} * ln(2.0)) AS BIGINT)"
USER_FILTER = f"""users AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events),
    sized AS (SELECT n, m, {COUNT.format(m="m", n="n")} AS h FROM (SELECT n, {BITS.format(n="n")} AS m FROM (SELECT count(*) + 50 AS n FROM users)))"""
FILTER = f"{USER_FILTER}, bits AS (SELECT DISTINCT {position('key', 'i', 'm')} AS pos FROM users, sized, range(10) t(i) WHERE i < h)"

RECORDS = f"""rec AS (SELECT c_name AS k, {crc32('c_name')} AS crc, CAST(29 + length(c_name) + length(c_mktsegment) AS BIGINT) AS record_size FROM customer, crc),
    placed AS (SELECT *, CAST(48 + coalesce(sum(record_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM rec),
    ind AS (SELECT k, "offset", CAST(coalesce(sum(16 + length(k)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS index_offset FROM placed),
    summ AS (SELECT place // 3 AS seg, k, index_offset FROM (SELECT *, row_number() OVER (ORDER BY k) - 1 AS place FROM ind) WHERE place % 3 = 0)"""

SPLIT = "{log}, lev AS (SELECT log.*, {runs} - least({runs} - 1, (lsn - 1) * {runs} // top) AS level FROM log, (SELECT max(lsn) AS top FROM log))"
TWO, FOUR = SPLIT.format(log=LOG, runs=2), SPLIT.format(log=LOG, runs=4)
MERGED = f"{TWO}, merged AS (SELECT k, arg_max(v, (ts_us, -level, lsn)) AS v, max(ts_us) AS ts_us, arg_max(tomb, (ts_us, -level, lsn)) AS tomb, CAST(3 - arg_max(level, (ts_us, -level, lsn)) AS INT) AS src FROM lev GROUP BY k)"
BY_LEVEL = "SELECT k, arg_min(v, (level, -ts_us, -lsn)) AS v, CAST(min(level) AS INT) AS level FROM lev WHERE {where} GROUP BY k"


def _listed(text: str) -> str:
    return f"'[' || array_to_string(list_transform(range(CAST(length({text}) AS BIGINT)), lambda i: CAST(ascii(substr({text}, i + 1, 1)) AS VARCHAR)), ' ') || ']'"


def _tree(value: str, where: str = "true") -> str:
    """The levels of each nation's tree as lists of hex hashes."""
    text = f"'{{CRC:0 timestamp:' || c_custkey || ' tombstone:0 KeySize:0 ValueSize:0 key:' || {_listed('c_name')} || ' value:' || {_listed(value)} || '}}'"
    return f"""leaf AS (SELECT c_nationkey AS g, list(sha1({text}) ORDER BY c_custkey) AS l, count(*) AS n FROM (SELECT * REPLACE ({value} AS c_mktsegment) FROM customer WHERE {where}) GROUP BY c_nationkey),
    tree AS (SELECT g, n, 0 AS level, list_concat(l, list_transform(range(CAST(pow(2, greatest(2, ceil(log2(n)))) AS BIGINT) - n), lambda i: repeat('0', 40))) AS l FROM leaf
        UNION ALL SELECT g, n, level + 1, list_transform(range(len(l) // 2), lambda i: sha1(unhex(l[2 * i + 1]) || unhex(l[2 * i + 2]))) FROM tree WHERE len(l) > 1)""".replace(_listed(value), _listed("c_mktsegment"))


def _roots(name: str) -> str:
    return f"SELECT g, n, l[1] AS root FROM {name} WHERE len(l) = 1"


CHANGED = "CASE WHEN c_custkey = 1 THEN 'CHANGED' ELSE c_mktsegment END"
REGISTERS = f"""regs AS (SELECT {{group}}h >> 16 AS bucket, CAST(max(CASE WHEN h = 0 THEN 33 ELSE 1 + log2(h & -h) END) AS INT) AS rank
    FROM (SELECT {{group}}{fnv1('key')} AS h FROM (SELECT DISTINCT {{select}}CAST(o_custkey AS VARCHAR) AS key FROM orders)) GROUP BY {{group}}bucket)"""
ESTIMATE = """SELECT {group}round(CASE WHEN raw <= 2.5 * 65536 THEN CASE WHEN n_nonempty < 65536 THEN 65536 * ln(65536.0 / (65536 - n_nonempty)) ELSE raw END
    WHEN raw > 4294967296 / 30.0 THEN -4294967296 * ln(1 - raw / 4294967296.0) ELSE raw END, 4) AS est{more}
    FROM (SELECT {group}count(*) AS n_nonempty, 0.7213 / (1 + 1.079 / 65536) * 65536.0 * 65536.0 / (sum(pow(2.0, -rank)) + 65536 - count(*)) AS raw FROM regs {by})"""
TOKENS = """toks AS (SELECT doc_id, lower(regexp_replace(w, '[,.!?:;]$', '')) AS tok, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w != '' GROUP BY ALL)"""
PRINTS = f"""{TOKENS},
    hist AS (SELECT doc_id, p, substr(md5(tok), p + 1, 1) AS c, sum(n) AS n FROM toks, range(32) t(p) GROUP BY ALL),
    bit AS (SELECT doc_id, 8 * p + b AS place, sum(CASE WHEN (ascii(c) >> (7 - b)) & 1 = 1 THEN n ELSE -n END) AS s FROM hist, range(8) t(b) GROUP BY ALL),
    prints AS (SELECT doc_id, string_agg(CASE WHEN s > 0 THEN '1' ELSE '0' END, '' ORDER BY place) AS h FROM bit GROUP BY doc_id)"""

ORACLES: dict[str, str] = {
    "kv_put_latest": f"WITH {LOG}, {NEWEST} SELECT * FROM state",
    "kv_upsert_lww": f"WITH {LOG} SELECT k, arg_max(v, (ts_us, lsn)) AS v, count(*) AS n_versions FROM log WHERE tomb = 0 GROUP BY k",
    "kv_delete_tombstone": f"WITH {LOG}, {NEWEST} SELECT k, v, ts_us FROM state WHERE tomb = 1",
    "kv_live_state": f"WITH {LOG}, {NEWEST} SELECT k, v FROM state WHERE tomb = 0",
    "kv_purge": f"WITH {LOG}, {NEWEST} SELECT k, v FROM state WHERE k NOT IN (SELECT k FROM state WHERE tomb = 1)",
    "kv_get_point": f"WITH {LOG}, {NEWEST} SELECT * FROM state WHERE k = '7'",
    "kv_prefix_scan": f"WITH {PARTS} SELECT * FROM kv WHERE starts_with(k, 'blu')",
    "kv_range_scan": f"WITH {PARTS} SELECT * FROM kv WHERE k BETWEEN 'blue' AND 'red'",
    "kv_scan_page": f"WITH {PARTS} SELECT * FROM kv ORDER BY k LIMIT 5 OFFSET 5",
    "memtable_size": f"WITH {LOG} SELECT lsn // 100 AS bucket, count(DISTINCT k) AS n_keys FROM log GROUP BY bucket",
    "memtable_generations": f"WITH {GENERATIONS} SELECT generation, count(*) AS n, min(o_orderkey) AS min_k, max(o_orderkey) AS max_k FROM gen GROUP BY generation",
    "memtable_sorted_run": f"WITH {RUNS} SELECT generation, k, row_number() OVER (PARTITION BY generation ORDER BY k) - 1 AS pos FROM runs",
    "memtable_flushes": """WITH RECURSIVE r AS (SELECT event_type AS store, user_id AS k, event_id + 1 AS lsn, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
        s AS (SELECT store, rn, lsn, 0 AS generation, [k] AS held FROM r WHERE rn = 1
            UNION ALL SELECT r.store, r.rn, r.lsn, CASE WHEN len(held) >= 20 THEN generation + 1 ELSE generation END,
                CASE WHEN len(held) >= 20 THEN [r.k] WHEN list_contains(held, r.k) THEN held ELSE list_append(held, r.k) END FROM s JOIN r ON r.store = s.store AND r.rn = s.rn + 1)
        SELECT store, CAST(generation AS BIGINT) AS generation, max(len(held)) AS n_keys, count(*) AS n_puts, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM s GROUP BY store, generation""",
    "sst_record_layout": f"WITH {CRC}, {RECORDS} SELECT * FROM placed",
    "sst_crc_verify": f"WITH {CRC}, {RECORDS}, damaged AS (SELECT CASE WHEN crc % 5 = 0 THEN k || 'x' ELSE k END AS k, rec.crc AS was FROM rec) SELECT k, CASE WHEN {crc32('k')} = was THEN 1 ELSE 0 END AS ok FROM damaged, crc",
    "sst_index_probe": f"""WITH {CRC}, {RECORDS}, asked AS (SELECT probe, arg_max(seg, k) AS seg FROM summ, (VALUES {values(Q.CUSTOMERS)}) p(probe) WHERE k <= probe GROUP BY probe)
        SELECT probe, seg, coalesce("offset", -1) AS "offset" FROM asked LEFT JOIN ind ON ind.k = probe""",
    "sst_contents": f"""WITH {RUNS}, placed AS (SELECT generation, length(k) AS l, row_number() OVER (PARTITION BY generation ORDER BY k) - 1 AS place FROM runs),
        sizes AS (SELECT generation, count(*) AS n, sum(l + 37) AS a, sum(l + 16) AS b, sum(CASE WHEN place % 3 = 0 THEN l + 16 ELSE 0 END) AS c, {BITS.format(n="(count(*) + 50)")} AS m FROM placed GROUP BY generation)
        SELECT generation, n, CAST(48 AS BIGINT) AS records_at, CAST(48 + a AS BIGINT) AS index_at, CAST(48 + a + b AS BIGINT) AS summary_at, CAST(48 + a + b + c AS BIGINT) AS filter_at, CAST(48 + a + b + c + ceil(m / 8) AS BIGINT) AS end_at FROM sizes""",
    "lsm_manifest": """SELECT 1 AS level, 3 AS generation, count(DISTINCT user_id) AS n FROM events WHERE (event_id + 1) % 3 = 2
        UNION ALL SELECT 2, 2, count(DISTINCT user_id) FROM events WHERE (event_id + 1) % 3 < 2""",
    "sst_index": f"WITH {CRC}, {RECORDS} SELECT * FROM ind",
    "sst_summary": f"WITH {CRC}, {RECORDS} SELECT * FROM summ",
    "sst_zone_map": f"WITH {RUNS} SELECT generation, min(k) AS first_k, max(k) AS last_k, count(*) AS n FROM runs GROUP BY generation",
    "sst_summary_floor": f"WITH {CRC}, {RECORDS} SELECT probe, arg_max(seg, k) AS seg FROM summ, (VALUES {values(Q.CUSTOMERS)}) p(probe) WHERE k <= probe GROUP BY probe",
    "sst_lookup_pruned": f"""WITH {RUNS}, zones AS (SELECT generation, min(k) AS a, max(k) AS b, count(*) + 50 AS n FROM runs GROUP BY generation),
        sized AS (SELECT *, {COUNT.format(m="m", n="n")} AS h FROM (SELECT *, {BITS.format(n="n")} AS m FROM zones)),
        bits AS (SELECT DISTINCT generation, {position('k', 'i', 'm')} AS pos FROM runs JOIN sized USING (generation), range(10) t(i) WHERE i < h),
        asked AS (SELECT probe, generation, a, b, {position('probe', 'i', 'm')} AS pos FROM sized, (VALUES {values(Q.ORDERS)}) p(probe), range(10) t(i) WHERE i < h),
        tested AS (SELECT probe, generation, CASE WHEN probe BETWEEN any_value(a) AND any_value(b) THEN 1 ELSE 0 END AS zone_ok, min(CASE WHEN bits.pos IS NULL THEN 0 ELSE 1 END) AS bloom_ok FROM asked LEFT JOIN bits USING (generation, pos) GROUP BY probe, generation)
        SELECT probe, generation, zone_ok, bloom_ok, CASE WHEN zone_ok = 1 AND bloom_ok = 1 AND EXISTS (SELECT 1 FROM runs r WHERE r.k = probe AND r.generation = tested.generation) THEN 1 ELSE 0 END AS found FROM tested""",
    "compaction_merge": f"WITH {MERGED} SELECT * FROM merged",
    "compaction_drop_tombstones": f"WITH {MERGED} SELECT k, v FROM merged WHERE tomb = 0",
    "lsm_next_generation": f"SELECT coalesce(arg_min(generation, level) + 1, 0) AS next_gen FROM (VALUES {values(Q.MANIFEST)}) m(level, generation) WHERE generation >= 0",
    "lsm_lookup_level": f"WITH {FOUR} SELECT k, CAST(min(level) AS INT) AS level FROM lev GROUP BY k",
    "lsm_prefix_merge": f"WITH {FOUR} {BY_LEVEL.format(where="starts_with(k, '1')")}",
    "lsm_range_merge": f"WITH {FOUR} {BY_LEVEL.format(where="k BETWEEN '10' AND '19'")}",
    # A counter of flushes: level i holds 2^(i-1) flushes where that bit is set, the last one all that is left.
    "lsm_level_plan": f"""SELECT CAST(f AS INT) AS flush, CAST(l AS INT) AS level, CAST({Q.THRESHOLD} * CASE WHEN l = {Q.DEPTH} THEN f - f % (1 << ({Q.DEPTH} - 1)) ELSE 1 << (l - 1) END AS INT) AS n
        FROM range(1, {Q.FLUSHES + 1}) t(f), range(1, {Q.DEPTH + 1}) u(l) WHERE CASE WHEN l = {Q.DEPTH} THEN f >= 1 << ({Q.DEPTH} - 1) ELSE (f >> (l - 1)) & 1 = 1 END""",
    "bloom_params": f"SELECT event_type, n, m, {COUNT.format(m='m', n='n')} AS k FROM (SELECT *, {BITS.format(n='n')} AS m FROM (SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type))",
    "bloom_build": f"WITH {FILTER} SELECT pos FROM bits",
    "bloom_probe": f"WITH {FILTER} SELECT id, min(CASE WHEN pos IS NULL THEN 0 ELSE 1 END) AS maybe FROM (SELECT id, {position('CAST(id AS VARCHAR)', 'i', 'm')} AS want FROM range(1000) a(id), sized, range(10) t(i) WHERE i < h) LEFT JOIN bits ON pos = want GROUP BY id",
    "merkle_root": f"WITH RECURSIVE {_tree('c_mktsegment')} {_roots('tree')}",
    "merkle_levels": f"WITH RECURSIVE {_tree('c_mktsegment')} SELECT g, CAST(level AS INT) AS level, idx, CASE WHEN level = 0 THEN l[idx + 1] ELSE l[idx + 1] END AS hash FROM (SELECT g, level, l, n, unnest(range(len(l))) AS idx FROM tree) WHERE idx < ceil(n / pow(2, level))",
    "merkle_diff": f"WITH RECURSIVE {_tree('c_mktsegment')}, {_tree(CHANGED).replace('leaf', 'leaf2').replace('tree', 'tree2')} SELECT a.g, CASE WHEN a.root = b.root THEN 1 ELSE 0 END AS same FROM ({_roots('tree')}) a JOIN ({_roots('tree2')}) b ON a.g = b.g",
    "wal_segments": f"WITH {LOG} SELECT (lsn - 1) // 10 AS segment, count(*) AS n, min(lsn) AS min_lsn, max(lsn) AS max_lsn FROM log GROUP BY segment",
    "wal_dump": f"WITH {LOG} SELECT *, (lsn - 1) // 10 AS segment FROM log",
    "wal_crc": f"WITH {CRC}, {LOG}, txt AS (SELECT lsn, ts_us || ',' || tomb || ',' || k || ',' || v AS t FROM log) SELECT lsn, {crc32('txt.t')} AS crc FROM txt, crc",
    "wal_verify": f"""WITH {CRC}, {LOG}, txt AS (SELECT lsn, ts_us || ',' || tomb || ',' || k || ',' AS t, v, CASE WHEN lsn % 7 = 0 THEN v + 1 ELSE v END AS now FROM log),
        both_ AS (SELECT lsn, t || v AS was, t || now AS now FROM txt) SELECT lsn, CASE WHEN {crc32('was')} = {crc32('now')} THEN 1 ELSE 0 END AS ok FROM both_, crc""",
    "wal_current_segment": f"WITH {LOG} SELECT (lsn - 1) // 10 AS segment, count(*) AS n FROM log GROUP BY segment ORDER BY segment DESC LIMIT 1",
    "wal_replay": f"WITH {LOG}, {NEWEST} SELECT k, v, tomb FROM state",
    "lru_hits": """WITH t AS (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
        d AS (SELECT a.event_id, count(DISTINCT b.user_id) AS n FROM t a JOIN t b ON b.event_id > a.p AND b.event_id < a.event_id GROUP BY a.event_id)
        SELECT t.event_id, CASE WHEN p IS NOT NULL AND coalesce(n, 0) < 16 THEN 1 ELSE 0 END AS hit FROM t LEFT JOIN d USING (event_id)""",
    "lru_final_state": "SELECT k, CAST(row_number() OVER (ORDER BY place DESC) AS INT) AS recency FROM (SELECT CAST(user_id AS VARCHAR) AS k, max(event_id) AS place FROM events GROUP BY user_id) ORDER BY place DESC LIMIT 16",
    "token_bucket_admit": f"""WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
        s AS (SELECT user_id, event_id, rn, t - 5000000 AS last, 2 AS left_, 1 AS ok FROM r WHERE rn = 1
            UNION ALL SELECT r.user_id, r.event_id, r.rn, CASE WHEN last < t AND t < last + {Q.DAY} THEN last ELSE t END,
                CASE WHEN last < t AND t < last + {Q.DAY} THEN greatest(left_ - 1, 0) ELSE 3 END,
                CASE WHEN last < t AND t < last + {Q.DAY} AND left_ = 0 THEN 0 ELSE 1 END FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1)
        SELECT user_id, event_id, ok FROM s""",
    "cms_params": f"SELECT CAST(eps AS DOUBLE) AS eps, CAST(delta AS DOUBLE) AS delta, CAST(ceil(exp(1.0) / eps) AS BIGINT) AS m, CAST(ceil(ln(exp(1.0) / delta)) AS BIGINT) AS k FROM (VALUES {values(Q.SIZES)}) s(eps, delta)",
    "cms_table": f"SELECT CAST(i AS INT) AS r, {cell('event_type', 'i')} AS c, count(*) AS n FROM events, range({Q.CMS_K}) t(i) GROUP BY ALL",
    "cms_estimate": f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS k, count(*) AS exact FROM events GROUP BY user_id), cells AS (SELECT k, exact, i, {cell('k', 'i')} AS c FROM e, range({Q.CMS_K}) t(i)),
        sums AS (SELECT i, c, CAST(sum(exact) AS BIGINT) AS n FROM cells GROUP BY i, c) SELECT k, min(n) AS est, any_value(exact) AS exact FROM cells JOIN sums USING (i, c) GROUP BY k""",
    "cms_by_group": f"SELECT event_type AS name, CAST(i AS INT) AS r, {cell('CAST(user_id AS VARCHAR)', 'i')} AS c, count(*) AS n FROM events, range({Q.CMS_K}) t(i) GROUP BY ALL",
    "cms_store": f"SELECT event_type AS name, CAST(i AS INT) AS r, {cell('CAST(user_id AS VARCHAR)', 'i')} AS c, count(*) AS n FROM events, range({Q.CMS_K}) t(i) GROUP BY ALL",
    "hll_registers": f"WITH {REGISTERS.format(group='', select='')} SELECT * FROM regs",
    "hll_estimate_compat": f"WITH {REGISTERS.format(group='', select='')} {ESTIMATE.format(group='', more=', n_nonempty', by='')}",
    "hll_by_group": f"WITH {REGISTERS.format(group='name, ', select='substr(o_orderpriority, 1, 16) AS name, ')} {ESTIMATE.format(group='name, ', more='', by='GROUP BY name')}",
    "hll_store": f"WITH {REGISTERS.format(group='name, ', select='substr(o_orderpriority, 1, 16) AS name, ')} {ESTIMATE.format(group='name, ', more='', by='GROUP BY name')}",
    "approx_distinct": "SELECT count(DISTINCT o_custkey) AS exact, true AS within FROM orders",
    "bloom_store": f"""WITH users AS (SELECT DISTINCT event_type AS name, CAST(user_id AS VARCHAR) AS key FROM events),
        sized AS (SELECT *, {COUNT.format(m="m", n="n")} AS h FROM (SELECT name, n, {BITS.format(n="n")} AS m FROM (SELECT name, count(*) + 50 AS n FROM users GROUP BY name))),
        bits AS (SELECT DISTINCT name, {position('key', 'i', 'm')} AS pos FROM users JOIN sized USING (name), range(10) t(i) WHERE i < h),
        asked AS (SELECT name, id, {position('CAST(id AS VARCHAR)', 'i', 'm')} AS pos FROM (SELECT DISTINCT event_type AS name, 2 * user_id AS id FROM events) JOIN sized USING (name), range(10) t(i) WHERE i < h)
        SELECT name, id, min(CASE WHEN bits.pos IS NULL THEN 0 ELSE 1 END) AS maybe FROM asked LEFT JOIN bits USING (name, pos) GROUP BY name, id""",
    "random_puts": f"SELECT id + 1 AS lsn, {letters('k', generator.KEY)} AS k, {letters('v', generator.VALUE)} AS v FROM range(1000) t(id)",
    "random_ints": "SELECT id, CAST(('0x' || substr(md5('42:i:' || id), 1, 8)) AS BIGINT) AS value FROM range(1000) t(id)",
    "simhash_tokens": f"WITH {TOKENS} SELECT * FROM toks",
    "simhash_fingerprint": f"WITH {PRINTS} SELECT * FROM prints",
    "simhash_hamming": f"WITH {PRINTS} SELECT a.doc_id AS a, b.doc_id AS b, CAST(list_sum(list_transform(range(256), lambda i: CASE WHEN substr(a.h, i + 1, 1) = substr(b.h, i + 1, 1) THEN 0 ELSE 1 END)) AS INT) AS dist FROM prints a JOIN prints b ON b.doc_id = a.doc_id + 1",
}
