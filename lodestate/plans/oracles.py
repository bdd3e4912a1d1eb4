"""Independent SQL for the registered queries, runnable by DuckDB over views of the same tables."""

from __future__ import annotations

EVENTS = """ev AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) AS now_us, event_type AS kind,
    coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"""
WRITES = EVENTS + """, wr AS (
    SELECT key, seq, now_us, kind, CAST(cents AS VARCHAR) AS value, CASE WHEN kind = 'signup' THEN now_us + k * 3600000000 END AS expires_us
    FROM ev WHERE kind IN ('signup', 'purchase', 'error')
), lg AS (
    SELECT *, lag(kind) OVER w AS pk, lag(expires_us) OVER w AS pe, lead(seq) OVER w AS nxt FROM wr WINDOW w AS (PARTITION BY key ORDER BY seq)
), lf AS (
    SELECT *, CAST(sum(CASE WHEN kind <> 'error' AND (pk IS NULL OR pk = 'error' OR pe <= now_us) THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS BIGINT) AS life FROM lg
), vs AS (
    SELECT key, seq, now_us, life, row_number() OVER (PARTITION BY key, life ORDER BY seq) AS version, value, expires_us, nxt FROM lf WHERE kind <> 'error'
), st AS (SELECT key, value, version, expires_us, (SELECT max(now_us) FROM ev) AS at_us FROM vs WHERE nxt IS NULL)"""
ENTRIES = """en AS (SELECT printf('order:%010d', o_orderkey) AS key, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS value,
    CAST(CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version, o_orderstatus AS status, o_orderpriority AS priority, o_orderkey AS id
    FROM orders WHERE o_orderkey % 17 <> 0)"""
INDEX = ENTRIES + """, ix AS (SELECT o_orderstatus AS term, printf('order:%010d', o_orderkey) AS prim,
    CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0 THEN 2 ELSE 1 END AS version FROM orders)"""
TABLETS = "tb(tablet, start_key, end_key) AS (VALUES (0, '', 'order:0000002000'), (1, 'order:0000002000', 'order:0000005000'), (2, 'order:0000005000', 'order:0000009000'), (3, 'order:0000009000', 'order:0000012000'), (4, 'order:0000012000', NULL))"
TELEMETRY = EVENTS + """, te AS (SELECT key % 8 AS scope, now_us // 3600000000 AS "window", seq AS sequence, key AS item, CASE WHEN kind = 'view' THEN 1 ELSE 0 END AS reads,
    CASE WHEN kind = 'view' THEN 0 ELSE 1 END AS writes, cents * 10000 AS latency_ns, kind = 'purchase' AS critical, cents > 10000 AS tail, k * 1000 AS stall FROM ev)"""
BATCHES = """ba AS (SELECT l_orderkey AS txn, l_partkey AS key, l_linenumber AS ord, CAST(l_quantity AS BIGINT) AS delta, l_suppkey AS route,
    CASE WHEN l_orderkey % 3 = 0 THEN 'Absent' WHEN l_orderkey % 5 = 0 THEN 'Version' ELSE 'Any' END AS expect, l_orderkey % 2 + 1 AS ev FROM lineitem),
co AS (SELECT * FROM ba QUALIFY row_number() OVER (PARTITION BY txn, key ORDER BY ord DESC, delta DESC) = 1),
ck AS (SELECT co.*, CASE expect WHEN 'Any' THEN true WHEN 'Absent' THEN p.v IS NULL ELSE p.v IS NOT DISTINCT FROM ev END AS ok
    FROM co LEFT JOIN (SELECT p_partkey, p_partkey % 2 + 1 AS v FROM part WHERE p_partkey % 4 <> 0) p ON key = p_partkey)"""
BOUNDED = EVENTS + """, bl AS (SELECT key % 10 AS key, CASE WHEN kind = 'click' THEN k ELSE -k END AS delta, row_number() OVER (PARTITION BY key % 10 ORDER BY seq) AS n FROM ev WHERE kind IN ('click', 'purchase')),
bf AS (
    SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS value, CAST(0 AS BIGINT) AS accepted, CAST(0 AS BIGINT) AS rejected FROM bl
    UNION ALL
    SELECT bf.key, bl.n, CASE WHEN value + delta BETWEEN 0 AND 500 THEN value + delta ELSE value END,
        accepted + CASE WHEN value + delta BETWEEN 0 AND 500 THEN 1 ELSE 0 END, rejected + CASE WHEN value + delta BETWEEN 0 AND 500 THEN 0 ELSE 1 END
    FROM bf JOIN bl ON bl.key = bf.key AND bl.n = bf.n + 1
), bv AS (SELECT key, value, accepted, rejected FROM bf QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1)"""
CHUNKS = """ch AS (SELECT doc_id AS key, i AS ordinal, substring(hex(encode(text)), CAST(i * 2048 + 1 AS BIGINT), 2048) AS hx
    FROM documents, LATERAL (SELECT unnest(range(CAST(ceil(octet_length(encode(text)) / 1024) AS BIGINT))) AS i))"""


def _with(parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts} {select}"


ORACLE_SQL = {
    "state_versions": _with(WRITES, "SELECT key, seq, life, version, value, expires_us FROM vs"),
    "state_get": _with(WRITES, "SELECT key, value, version, CAST(length(value) AS INTEGER) AS bytes FROM st WHERE expires_us IS NULL OR at_us < expires_us"),
    "state_expiry": _with(WRITES, """SELECT key, CASE WHEN expires_us <= at_us THEN 'Absent' WHEN expires_us IS NULL THEN 'Never' ELSE 'At' END AS expiry,
        CASE WHEN expires_us <= at_us THEN -2 WHEN expires_us IS NULL THEN -1 ELSE greatest(CAST(ceil((expires_us - at_us) / 1000000) AS BIGINT), 1) END AS ttl,
        CASE WHEN expires_us <= at_us THEN -2 WHEN expires_us IS NULL THEN -1 ELSE greatest((expires_us - at_us) // 1000, 0) END AS pttl,
        CASE WHEN expires_us <= at_us THEN -2 WHEN expires_us IS NULL THEN -1 ELSE expires_us // 1000000 END AS expiretime FROM st"""),
    "state_collect_expired": _with(WRITES, "SELECT key FROM st WHERE at_us >= expires_us ORDER BY key LIMIT 25"),
    "reads_get_and_exists": _with(WRITES, """SELECT r.seq, CASE r.kind WHEN 'view' THEN 'get' ELSE 'exists' END AS op,
        coalesce(w.kind <> 'error' AND (w.expires_us IS NULL OR r.now_us < w.expires_us), false) AS found,
        CASE WHEN r.kind = 'view' AND w.kind <> 'error' AND (w.expires_us IS NULL OR r.now_us < w.expires_us) THEN w.value END AS value
        FROM ev r ASOF LEFT JOIN wr w ON r.key = w.key AND r.seq > w.seq WHERE r.kind IN ('view', 'click')"""),
    "bytes_get_range": _with(ENTRIES, "SELECT key, substring(value, 2, 3) AS head, right(value, 3) AS tail, '' AS past FROM en"),
    "counter_values": _with(EVENTS + """, cl AS (SELECT key, seq, kind, CASE kind WHEN 'click' THEN k WHEN 'purchase' THEN -k END AS delta,
        sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS life FROM ev WHERE kind IN ('click', 'purchase', 'error'))""",
        "SELECT key, seq, CAST(sum(delta) OVER w AS BIGINT) AS value, row_number() OVER w AS version FROM cl WHERE kind <> 'error' WINDOW w AS (PARTITION BY key, life ORDER BY seq)"),
    "counter_commutative": _with(EVENTS, "SELECT key, CAST(sum(CASE kind WHEN 'click' THEN k ELSE -k END) AS BIGINT) AS value, count(*) AS adds FROM ev WHERE kind IN ('click', 'purchase') GROUP BY key"),
    "counter_bounded": _with(BOUNDED, "SELECT * FROM bv", True),
    "escrow_transfer": _with(BOUNDED, """SELECT a.key AS donor, b.key AS recipient, CASE WHEN 500 - g >= a.value THEN 'Ok' ELSE 'Conflict' END AS status,
        CASE WHEN 500 - g >= a.value THEN 500 - g ELSE 500 END AS donor_max, CASE WHEN 500 - g >= a.value THEN 500 + g ELSE 500 END AS recipient_max
        FROM (SELECT *, (key + 1) * 50 AS g FROM bv) a JOIN bv b ON b.key = (a.key + 1) % 10""", True),
    "stream_append": _with(EVENTS, "SELECT key % 4 AS shard, row_number() OVER (PARTITION BY key % 4 ORDER BY seq) - 1 AS \"offset\", key AS partition, seq FROM ev"),
    "stream_read_after_trim": _with(EVENTS, "SELECT * FROM (SELECT key % 4 AS shard, row_number() OVER (PARTITION BY key % 4 ORDER BY seq) - 1 AS \"offset\", seq FROM ev) WHERE \"offset\" BETWEEN 111 AND 130"),
    "scan_forward": _with(ENTRIES, "SELECT key, value, version FROM en WHERE key >= 'order:0000000100' AND key < 'order:0000009000' ORDER BY key LIMIT 200"),
    "scan_reverse_keys": _with(ENTRIES, "SELECT key, version FROM en WHERE key >= 'order:0000000100' ORDER BY key DESC LIMIT 150"),
    "scan_byte_budget": _with(ENTRIES + """, pg AS (SELECT key, CAST(sum(length(value)) OVER (ORDER BY key) AS BIGINT) AS total, row_number() OVER (ORDER BY key) AS n
        FROM (SELECT * FROM en WHERE key >= 'order:0000000500' ORDER BY key LIMIT 300))""", "SELECT key, CASE WHEN total <= 900 THEN 'Ok' ELSE 'Oversize' END AS status, total FROM pg WHERE total <= 900 OR n = 1"),
    "scan_cursor": _with(ENTRIES, "SELECT max(key) AS last_key, count(*) AS items FROM (SELECT key FROM en WHERE key >= 'order:0000000001' ORDER BY key LIMIT 64)"),
    "scan_median_split": _with(ENTRIES + """, rk AS (SELECT key, sum(length(key) + length(value)) OVER (ORDER BY key) AS run, sum(length(key) + length(value)) OVER () AS total,
        first_value(length(key) + length(value)) OVER (ORDER BY key) AS head, row_number() OVER (ORDER BY key) AS n FROM en)""", "SELECT min(key) AS split_key FROM rk WHERE n > 1 AND 2 * (run - head) >= total"),
    "store_stats": _with(ENTRIES, "SELECT count(*) AS object_count, CAST(sum(length(key)) AS BIGINT) AS key_bytes, CAST(sum(length(value)) AS BIGINT) AS value_bytes FROM en"),
    "route_keys": _with(ENTRIES + ", " + TABLETS, "SELECT tablet, count(*) AS keys, min(key) AS first_key, max(key) AS last_key FROM en JOIN tb ON key >= start_key AND (end_key IS NULL OR key < end_key) GROUP BY tablet"),
    "index_equal": _with(INDEX, "SELECT prim AS \"primary\", value FROM ix JOIN en ON prim = key AND ix.version = en.version WHERE term = 'F' ORDER BY prim LIMIT 500"),
    "index_term_range": _with(INDEX + ", hits AS (SELECT * FROM ix WHERE term >= 'F' AND term < 'P' ORDER BY term, prim LIMIT 700)", "SELECT term, prim AS \"primary\" FROM hits JOIN en ON prim = key AND hits.version = en.version"),
    "index_unique_claims": "SELECT o_custkey AS term, min(o_orderkey) AS owner, count(DISTINCT o_orderkey) - 1 AS refused FROM orders GROUP BY o_custkey",
    "index_stale_entries": _with(INDEX, "SELECT term, prim AS \"primary\" FROM ix WHERE NOT EXISTS (SELECT 1 FROM en WHERE key = prim AND en.version = ix.version)"),
    "index_term_diff": _with(ENTRIES, "SELECT key AS \"primary\", 'X' AS put, status AS gone FROM en WHERE id % 5 = 0"),
    "txn_outcomes": _with(BATCHES, "SELECT txn, CASE WHEN bool_and(ok) THEN 'Ok' ELSE 'TxnConflict' END AS status, count(*) AS n_keys FROM ck GROUP BY txn"),
    "txn_committed_totals": _with(BATCHES, "SELECT key, CAST(sum(delta) AS BIGINT) AS total FROM ck WHERE txn IN (SELECT txn FROM ck GROUP BY txn HAVING bool_and(ok)) GROUP BY key"),
    "txn_coordinators": _with(BATCHES, "SELECT txn, min(route % 16) AS coordinator, count(DISTINCT route % 16) AS participants FROM ba GROUP BY txn"),
    "txn_decisions": _with(EVENTS, "SELECT key % 50 AS txn, arg_min(CASE kind WHEN 'purchase' THEN 'Committed' ELSE 'Aborted' END, seq) AS decision, count(DISTINCT kind) > 1 AS conflict FROM ev WHERE kind IN ('purchase', 'error') GROUP BY key % 50"),
    "exactly_once": _with(EVENTS, """SELECT key % 40 AS session, seq // 3 AS request, min(seq) AS "commit", arg_min(CASE kind WHEN 'click' THEN k WHEN 'purchase' THEN -k ELSE 0 END, seq) AS delta, count(*) AS attempts
        FROM ev WHERE kind IN ('click', 'purchase', 'error') GROUP BY key % 40, seq // 3"""),
    "read_freshness": _with(INDEX, "SELECT CASE WHEN ix.version = en.version THEN 'Current' WHEN ix.version < en.version THEN 'Stale' ELSE 'Future' END AS freshness, count(*) AS entries FROM ix JOIN en ON prim = key GROUP BY 1"),
    "telemetry_monotone": _with(TELEMETRY + ", tm AS (SELECT scope, sequence AS a, CASE WHEN sequence % 13 = 0 THEN sequence - 40 ELSE sequence END AS s FROM te), tn AS (SELECT *, max(s) OVER (PARTITION BY scope ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM tm)",
        "SELECT scope, count(*) AS accepted FROM tn WHERE b IS NULL OR s > b GROUP BY scope"),
    "telemetry_latency": _with(TELEMETRY + ", rc AS (SELECT * FROM te QUALIFY row_number() OVER (PARTITION BY scope ORDER BY sequence DESC) <= 256)",
        "SELECT scope, count(*) AS n, quantile_disc(latency_ns, 0.5) AS p50, quantile_disc(latency_ns, 0.99) AS p99, quantile_disc(latency_ns, 0.999) AS p999, max(latency_ns) AS max FROM rc GROUP BY scope"),
    "telemetry_hot_keys": _with(TELEMETRY + """, hk AS (SELECT scope, item, count(*) AS hits, count(*) FILTER (critical) AS c, count(*) FILTER (tail) AS t, sum(count(*)) OVER (PARTITION BY scope) AS total,
        row_number() OVER (PARTITION BY scope ORDER BY count(*) DESC, item) AS rank FROM te GROUP BY scope, item)""",
        """SELECT scope, rank, item, hits, CASE WHEN hits = 1 THEN 'Cold' WHEN hits * 100 >= total THEN 'Hot' ELSE 'Warm' END AS hotness,
        CASE WHEN 2 * c >= hits THEN 'CriticalPath' WHEN 2 * t >= hits THEN 'TailSensitive' ELSE 'Ordinary' END AS class FROM hk WHERE rank <= 10"""),
    "telemetry_concentration": _with(TELEMETRY + ", cc AS (SELECT scope, count(*) AS hits, row_number() OVER (PARTITION BY scope ORDER BY count(*) DESC, item) AS rank FROM te GROUP BY scope, item)",
        """SELECT scope, max(hits) AS top1, CAST(sum(CASE WHEN rank <= 10 THEN hits ELSE 0 END) AS BIGINT) AS top10, CAST(sum(hits) AS BIGINT) AS total, CAST(sum(hits * hits) AS BIGINT) AS squares,
        sum(hits * hits) / (sum(hits) * sum(hits)) AS herfindahl FROM cc GROUP BY scope"""),
    "telemetry_weighted_score": _with(TELEMETRY + ", wi AS (SELECT scope, item, max(stall) AS s, count(*) AS n FROM te GROUP BY scope, item)", "SELECT scope, CAST(sum(s * n) // sum(n) AS BIGINT) AS mean_score, max(s) AS peak FROM wi GROUP BY scope"),
    "telemetry_criticality": _with(TELEMETRY + ", cr AS (SELECT item, count(*) AS n, CAST(sum(latency_ns) AS BIGINT) AS lat, CAST(sum(stall) AS BIGINT) AS stall, count(*) FILTER (critical) AS c, count(*) FILTER (tail) AS t FROM te GROUP BY item)",
        """SELECT item, CAST((CAST(n * (lat // n) + stall AS HUGEINT) * (100000 + (c * 1000000 // n) // 2 + (t * 1000000 // n) // 2)) // 1000000 // greatest(item * 10, 1) AS BIGINT) AS score FROM cr"""),
    "control_sustained": _with(TELEMETRY + """, fl AS (SELECT scope, "window" AS w, sum(writes) > 3 * sum(reads) AS f FROM te GROUP BY 1, 2),
        isl AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY scope ORDER BY w) AS i FROM fl), rn AS (SELECT *, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY scope, i ORDER BY w) AS BIGINT) AS run FROM isl)""",
        "SELECT scope, w AS \"window\", run, run >= 3 AS sustained FROM rn"),
    "control_split_or_merge": _with(ENTRIES + ", " + TABLETS + ", tc AS (SELECT tablet, start_key, count(*) AS n FROM en JOIN tb ON key >= start_key AND (end_key IS NULL OR key < end_key) GROUP BY 1, 2)",
        "SELECT tablet, CASE WHEN n >= 3500 THEN 'Split' WHEN n <= 3000 AND lead(n) OVER (ORDER BY start_key) <= 3000 THEN 'Merge' ELSE 'Keep' END AS action FROM tc"),
    "storage_chunks": _with(CHUNKS, "SELECT sha256(unhex(hx)) AS digest, CAST(max(length(hx) // 2) AS INTEGER) AS bytes, count(*) AS refs FROM ch GROUP BY 1"),
    "storage_manifests": _with(CHUNKS, "SELECT key, CAST(sum(length(hx) // 2) AS BIGINT) AS logical_len, sha256(string_agg(sha256(unhex(hx)), '' ORDER BY ordinal)) AS manifest FROM ch GROUP BY key"),
    "storage_reclaim": _with(EVENTS, "SELECT seq // 64 AS segment FROM ev GROUP BY 1 HAVING max(seq) <= (SELECT min(f) FROM (SELECT max(seq) AS f FROM ev GROUP BY key % 8))"),
}


def ordered(steps: str, state: str, start: str, step: str) -> str:
    """A fold as recursion: `steps` numbers each key's operations from 1, `step` gives the next state from f and o."""
    return f"""WITH RECURSIVE {EVENTS}, o AS ({steps}), f(key, n, seq, {state}) AS (
        SELECT DISTINCT key, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), {start} FROM o
        UNION ALL
        SELECT o.key, o.n, o.seq, {step}
        FROM (SELECT f.*, nx.now_us, v IS NOT NULL AND (ex IS NULL OR nx.now_us < ex) AS live, CASE WHEN v IS NOT NULL AND (ex IS NULL OR nx.now_us < ex) THEN ver ELSE 0 END AS lv FROM f JOIN o nx ON nx.key = f.key AND nx.n = f.n + 1) f
        JOIN o ON o.key = f.key AND o.n = f.n + 1
    )"""


ORACLE_SQL |= {
    "expiry_edits": ordered(
        "SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM ev",
        "applied, v, ver, ex",
        "false, CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(NULL AS BIGINT)",
        """CASE WHEN kind IN ('signup', 'purchase') THEN true WHEN kind = 'view' THEN live AND ex IS NOT NULL ELSE live END,
        CASE WHEN kind IN ('signup', 'purchase') THEN hex(CAST(cents AS VARCHAR)) WHEN kind <> 'error' AND live THEN v END,
        CASE WHEN kind = 'error' THEN 0 WHEN kind IN ('signup', 'purchase') OR live AND (kind = 'click' OR ex IS NOT NULL) THEN lv + 1 ELSE lv END,
        CASE WHEN kind = 'signup' THEN o.now_us + k * 3600000000 WHEN kind = 'click' AND live THEN o.now_us + k * 60000000 END""",
    )
    + " SELECT key, seq, applied, ver AS version, ex AS expires_us, v AS value_hex FROM f WHERE n > 0",
    "bytes_splice": ordered(
        "SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM ev WHERE kind <> 'purchase'",
        "applied, v, ver, ex, rd",
        "false, CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR)",
        """kind IN ('signup', 'click') OR live,
        CASE kind WHEN 'signup' THEN hex(CAST(cents AS VARCHAR)) WHEN 'view' THEN v
            WHEN 'click' THEN rpad(coalesce(v, ''), CAST(2 * (k % 16) AS INT), '0') || hex(lpad(CAST(o.seq % 100 AS VARCHAR), 2, '0')) || substr(coalesce(v, ''), 2 * (k % 16) + 5) END,
        CASE kind WHEN 'error' THEN 0 WHEN 'view' THEN lv ELSE lv + 1 END, NULL, CASE WHEN kind = 'view' THEN substr(v, 2 * (k % 8) + 1, 8) END""",
    )
    + " SELECT key, seq, applied, ver AS version, v AS value_hex, rd AS read_hex FROM f WHERE n > 0",
}

ASSETS = """az AS (SELECT p_partkey, p_partkey AS n, CAST(p_size AS BIGINT) AS s FROM part), ap AS (
    SELECT p_partkey, n % 12 AS domain, s * 1000000 * (s % 3) AS rb,
        CASE WHEN s % 7 < 4 THEN 1000000000000 WHEN s % 7 = 4 THEN 800000000000 WHEN s % 7 = 5 THEN 600000000000 ELSE 0 END
        + greatest(4 - s % 7, 0) * 1000000000 + (2 - greatest(s % 7 - 4, 0)) * 500000000 + n % 3 * 10000000 + n % 2 * 2000000 + n % 5 * 20000000 + n % 4 * 5000000
        + n % 6 * 1000000 + n % 7 * 2000000 + (6 - s % 7) * 250000 + least(n * 100000, 86400000) * 10000 + least(s * 1000, 86400000) * 2000
        + CASE WHEN n = 0 THEN 0 WHEN n * 900000 <= 1048576 THEN 1000 WHEN n * 900000 <= 67108864 THEN 4000 WHEN n * 900000 <= 1073741824 THEN 8000 ELSE 16000 END
        + CASE WHEN s * 1000000 * (s % 3) = 0 THEN 0 WHEN s * 1000000 * (s % 3) <= 1048576 THEN 1000 WHEN s * 1000000 * (s % 3) <= 67108864 THEN 4000 WHEN s * 1000000 * (s % 3) <= 1073741824 THEN 8000 ELSE 16000 END AS priority
    FROM az)"""

ORACLE_SQL |= {
    "stream_shards": """SELECT c_custkey, CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::HUGEINT)),
        lambda h, b: xor(h, b) * 1099511628211::HUGEINT % 18446744073709551616::HUGEINT) % 7 AS BIGINT) AS shard FROM customer""",
    "index_backfill": _with(ENTRIES, "SELECT DISTINCT unnest([status, priority]) AS term, key AS \"primary\", version FROM en WHERE version = 1"),
    "txn_escrow_conserved": "SELECT l_orderkey AS txn, count(*) FILTER (l_linenumber % 2 = 1) = count(*) FILTER (l_linenumber % 2 = 0) AS conserved FROM lineitem GROUP BY ALL",
    "txn_write_set_digest": _with(BATCHES, "SELECT txn, sha256(string_agg(printf('%010d=%d', key, delta), ';' ORDER BY key)) AS digest FROM co GROUP BY ALL"),
    "txn_blocked": _with(EVENTS, """SELECT key, seq, CASE WHEN kind = 'click' AND (SELECT arg_max(p.kind, p.seq) FROM ev p WHERE p.key = e.key AND p.seq < e.seq AND p.kind IN ('signup', 'purchase', 'error')) = 'signup'
        THEN 'TxnConflict' ELSE 'Ok' END AS status FROM ev e WHERE kind IN ('click', 'view')"""),
    "txn_resolve": _with(EVENTS + """, nx AS (SELECT seq, now_us, kind, lead(kind) OVER (PARTITION BY key ORDER BY seq) AS after FROM ev WHERE kind IN ('signup', 'purchase', 'error'))""", """SELECT seq AS txn,
        CASE after WHEN 'purchase' THEN 'Finalize' WHEN 'error' THEN 'Release' ELSE CASE WHEN (SELECT max(now_us) FROM ev) - now_us > 216000000000 THEN 'Abort' ELSE 'Wait' END END AS action FROM nx WHERE kind = 'signup'"""),
    "read_at_least": _with(EVENTS + ", al AS (SELECT key % 8 AS lane, max(seq) - 40 AS applied FROM ev WHERE seq % 3 <> 0 GROUP BY ALL)", """SELECT seq AS id,
        CASE WHEN lane IS NULL THEN 'Unavailable' WHEN seq % 9 = 0 THEN 'StaleToken' WHEN applied >= seq THEN 'Ok' ELSE 'Unavailable' END AS status FROM ev LEFT JOIN al ON lane = key % 10 WHERE kind = 'view'"""),
    "telemetry_latest": _with(TELEMETRY, "SELECT scope, \"window\", sequence, item, stall FROM te QUALIFY row_number() OVER (PARTITION BY scope, \"window\" ORDER BY sequence DESC) = 1"),
    "telemetry_savings": """SELECT "group", CAST(p AS DOUBLE) / r AS ratio, CAST(r - p AS DOUBLE) / r AS savings FROM (
        SELECT l_suppkey AS "group", sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS r, sum(CAST(round(l_extendedprice * 100) AS BIGINT) + l_linenumber * 1000 - l_partkey) AS p FROM lineitem GROUP BY ALL)""",
    "storage_adopt_compression": "SELECT o_orderkey AS key, 100 * (r * (o_custkey % 30) // 100) >= 15 * r AS adopted FROM (SELECT *, CAST(round(o_totalprice) AS BIGINT) AS r FROM orders)",
    "telemetry_hardware": _with(EVENTS + ", hw AS (SELECT key % 50 AS scope, min(seq % 101 + 5) AS trust, max(k) AS mk, max(cents) AS mc, CAST(sum(k) AS BIGINT) AS misses FROM ev GROUP BY ALL)", """SELECT scope, trust,
        mk / 100 AS stall, mc / 10000 AS ipc, misses, CASE WHEN mk > 35 AND misses > 200 THEN 'Memory' WHEN mc >= 15000 AND mk < 15 THEN 'Cpu' ELSE 'Neither' END AS bound FROM hw"""),
    "telemetry_evidence": _with(TELEMETRY, "SELECT scope, min(sequence) AS oldest, max(sequence) AS newest, min(sequence % 997) AS confidence, bit_or(1::BIGINT << CAST(item % 13 AS INT)) AS sources FROM te GROUP BY ALL"),
    "telemetry_access_rollup": _with(TELEMETRY + ", ac AS (SELECT scope, item, CAST(sum(reads) AS BIGINT) AS a, CAST(sum(stall) AS BIGINT) AS c, count(*) AS b FROM te GROUP BY ALL)", """SELECT scope, CAST(sum(a) AS BIGINT) AS accesses,
        CAST(sum(a // 2) AS BIGINT) AS critical, CAST(sum(c) AS BIGINT) AS stall_ns, max(coalesce(c // nullif(a, 0), 1)) AS latency_ns, CAST(sum(b) + 1 AS BIGINT) AS bytes FROM ac GROUP BY ALL"""),
    "telemetry_trials": """SELECT *, (most - least) / throughput AS spread FROM (SELECT l_suppkey AS name, median(t) AS throughput, min(t) AS least, max(t) AS most, median(q) AS latency, max(q) - min(q) AS latency_spread, bool_and(l_orderkey % 500 <> 7) AS valid
        FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS t, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY ALL)""",
    "control_hysteresis": f"""WITH RECURSIVE {TELEMETRY}, hw AS (SELECT scope, "window", sum(writes) AS v FROM te GROUP BY ALL), hr AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY "window") AS n FROM hw), f(scope, n, "window", run) AS (
        SELECT DISTINCT scope, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM hr
        UNION ALL SELECT hr.scope, hr.n, hr."window", CASE WHEN v >= CASE WHEN run > 0 THEN 3 ELSE 5 END THEN run + 1 ELSE 0 END FROM f JOIN hr ON hr.scope = f.scope AND hr.n = f.n + 1
    ) SELECT scope, "window", run FROM f WHERE n > 0""",
    "control_repair_priority": _with(ASSETS, "SELECT p_partkey, priority FROM ap"),
    "control_debt": _with(ASSETS, "SELECT domain, count(*) AS assets, CAST(sum(rb) AS BIGINT) AS bytes, max(priority) AS priority FROM ap WHERE priority > 0 GROUP BY ALL"),
    "control_liveness": f"""WITH RECURSIVE {EVENTS}, pl AS (SELECT key % 20 AS key, seq, seq // 300 % 2 = 0 AS alive, row_number() OVER (PARTITION BY key % 20 ORDER BY seq) AS n FROM ev), f(key, n, seq, state, misses, since) AS (
        SELECT DISTINCT key, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), 'Active', CAST(0 AS BIGINT), CAST(1000000000 AS BIGINT) FROM pl
        UNION ALL SELECT pl.key, pl.n, pl.seq,
            CASE WHEN alive THEN 'Active' WHEN state = 'Active' AND since + 1 < 120 THEN state WHEN state = 'Active' AND misses + 1 >= 4 THEN 'Suspect' WHEN state = 'Suspect' AND misses + 1 >= 14 THEN 'Unavailable' ELSE state END,
            CASE WHEN alive THEN 0 ELSE misses + 1 END,
            CASE WHEN NOT alive THEN since + 1 WHEN state = 'Unavailable' THEN 0 WHEN state = 'Active' THEN since + 1 ELSE since END
        FROM f JOIN pl ON pl.key = f.key AND pl.n = f.n + 1
    ) SELECT key, seq, state, misses FROM f WHERE n > 0""",
}
