"""Queries over typed objects whose operations depend on the state before, each with its SQL as a recursion over a key's operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestate.operators import control, directory, erasure, fold, scan, storage
from lodestate.plans.oracles import BOUNDED, ENTRIES, EVENTS, WRITES
from lodestate.sources import oplog as S

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def recursion(steps: str, state: str, start: str, derived: str, step: str, out: str) -> str:
    """steps numbers each key's operations from 1; derived adds columns to the state f before operation o; step gives the next state."""
    return f"""WITH RECURSIVE {EVENTS}, o AS ({steps}), f(key, n, {state}) AS (
        SELECT DISTINCT key, CAST(0 AS BIGINT), {start} FROM o
        UNION ALL SELECT key, n, {step} FROM (SELECT *, {derived} FROM (SELECT f.* EXCLUDE (n), o.* EXCLUDE (key) FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1))
    ) {out}"""


LEASES = recursion(
    """SELECT key % 15 AS key, row_number() OVER (PARTITION BY key % 15 ORDER BY seq) AS n, seq, now_us AS t, kind, key // 15 % 3 AS who,
        CASE WHEN k = 0 THEN NULL ELSE now_us + k * 60000000 END AS until, CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END AS behind FROM ev WHERE kind IN ('signup', 'view', 'error')""",
    "sq, status, released, own, tok, ex, nxt",
    "CAST(-1 AS BIGINT), '', CAST(NULL AS BOOLEAN), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(1 AS BIGINT)",
    "tok IS NOT NULL AND (ex IS NULL OR t < ex) AS live, tok IS NOT NULL AND own = who AND tok = nxt - 1 - behind AS mine",
    """seq, CASE kind WHEN 'signup' THEN CASE WHEN live THEN 'LeaseConflict' ELSE 'Ok' END WHEN 'view' THEN CASE WHEN live AND mine THEN 'Ok' ELSE 'StaleFencing' END
            ELSE CASE WHEN tok IS NULL OR mine THEN 'Ok' ELSE 'StaleFencing' END END,
        CASE WHEN kind = 'error' AND (tok IS NULL OR mine) THEN tok IS NOT NULL END,
        CASE WHEN kind = 'signup' AND NOT live THEN who WHEN kind = 'error' AND mine THEN NULL ELSE own END,
        CASE WHEN kind = 'signup' AND NOT live THEN nxt WHEN kind = 'error' AND mine THEN NULL ELSE tok END,
        CASE WHEN kind = 'signup' AND NOT live OR kind = 'view' AND live AND mine THEN until WHEN kind = 'error' AND mine THEN NULL ELSE ex END,
        CASE WHEN kind = 'signup' AND NOT live THEN nxt + 1 ELSE nxt END""",
    "SELECT key, sq AS seq, status, released, tok AS token, ex AS expires_us, nxt AS next_token FROM f WHERE n > 0",
)


@query(LEASES)
def lease_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Status of every lease operation, and the holder's token, its end and the next token after it."""
    return fold.leases(S.lease_log(spark, d))


@query(
    LEASES.replace("SELECT key, sq AS seq, status,", "SELECT key, tok IS NOT NULL AND (ex IS NULL OR ex > (SELECT max(now_us) FROM ev)) AS held, nxt AS next_token, ").split(" released, tok AS token")[0]
    + " FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1"
)
def lease_inspect(spark: SparkSession, d: str) -> DataFrame:
    """Whether each lease is held at the log's end, and its next token."""
    log = S.lease_log(spark, d)
    last = fold.leases(log).groupBy("key").agg(F.max_by(F.struct("token", "expires_us", "next_token"), "seq").alias("s"))
    now = S.events(spark, d).agg(F.max("now_us").alias("at_us"))
    held = F.col("s.token").isNotNull() & (F.col("s.expires_us").isNull() | (F.col("s.expires_us") > F.col("at_us")))
    return last.join(F.broadcast(now)).select("key", held.alias("held"), "s.next_token")  # one row for all


@query(
    recursion(
        """SELECT key % 10 AS key, row_number() OVER (PARTITION BY key % 10 ORDER BY id) AS n, id, op, k, seq AS ev FROM (
            SELECT *, seq * 3 + 1 AS id, CASE kind WHEN 'signup' THEN 'share' WHEN 'view' THEN 'get' WHEN 'error' THEN 'create' WHEN 'click' THEN 'plus' ELSE 'minus' END AS op FROM ev
            UNION ALL SELECT *, seq * 3, 'drop' FROM ev WHERE kind = 'error' AND seq % 20 = 0
            UNION ALL SELECT * EXCLUDE (rk), seq * 3 - 1, 'create' FROM (SELECT *, row_number() OVER (PARTITION BY key % 10 ORDER BY seq) AS rk FROM ev) WHERE rk = 1)""",
        "sq, status, val, lo, hi, ver",
        "CAST(-1 AS BIGINT), '', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)",
        """CASE op WHEN 'plus' THEN val + k WHEN 'minus' THEN val - k END AS nv, CASE WHEN ev % 2 = 0 THEN k % 8 ELSE 0 END AS nl, CASE WHEN ev % 2 = 0 THEN 500 ELSE 500 - k % 8 END AS nh,
        op IN ('plus', 'minus') AND val IS NOT NULL AND nv BETWEEN greatest(lo, 0) AND least(hi, 500) AS moves, op = 'share' AND val IS NOT NULL AND nl >= lo AND nh <= hi AND val BETWEEN nl AND nh AS narrows""",
        """id, CASE op WHEN 'create' THEN CASE WHEN val IS NULL THEN 'Ok' ELSE 'WrongType' END WHEN 'get' THEN 'Ok' WHEN 'drop' THEN 'Ok' ELSE CASE WHEN moves OR narrows THEN 'Ok' ELSE 'BoundedExceeded' END END,
        CASE WHEN op = 'drop' THEN NULL WHEN op = 'create' AND val IS NULL THEN 0 WHEN moves THEN nv ELSE val END,
        CASE WHEN op = 'drop' THEN NULL WHEN op = 'create' AND val IS NULL THEN 0 WHEN narrows THEN nl ELSE lo END,
        CASE WHEN op = 'drop' THEN NULL WHEN op = 'create' AND val IS NULL THEN 500 WHEN narrows THEN nh ELSE hi END,
        CASE WHEN op = 'drop' THEN NULL WHEN op = 'create' AND val IS NULL THEN 1 WHEN moves OR narrows THEN ver + 1 ELSE ver END""",
        'SELECT key, sq AS seq, status, val AS "value", lo AS low, hi AS high, ver AS version FROM f WHERE n > 0',
    )
)
def bounded_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Creates, additions, reads and narrowed shares of bounded counters, refused ones without effect."""
    return fold.bounded(S.share_log(spark, d))


@query(
    recursion(
        """SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq) AS n, seq, kind, CAST(CASE kind WHEN 'click' THEN least(k, 7) WHEN 'purchase' THEN -least(k, 7) ELSE 0 END AS HUGEINT) * 576460752303423488 AS delta
        FROM ev WHERE kind IN ('click', 'purchase', 'error')""",
        "sq, status, val, ver",
        "CAST(-1 AS BIGINT), '', CAST(NULL AS HUGEINT), CAST(0 AS BIGINT)",
        "coalesce(val, 0) + delta AS nv, kind <> 'error' AND NOT nv BETWEEN -9223372036854775808::HUGEINT AND 9223372036854775807::HUGEINT AS over",
        "seq, CASE WHEN over THEN 'CounterOverflow' ELSE 'Ok' END, CASE WHEN kind = 'error' THEN NULL WHEN over THEN val ELSE nv END, CASE WHEN kind = 'error' THEN 0 WHEN over THEN ver ELSE ver + 1 END",
        'SELECT key, sq AS seq, status, CAST(val AS BIGINT) AS "value", ver AS version FROM f WHERE n > 0',
    )
)
def counter_overflow(spark: SparkSession, d: str) -> DataFrame:
    return fold.counters(S.overflow_log(spark, d))


CONDITIONAL = (
    """SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq) AS n, seq, now_us AS t, kind, k, CAST(cents AS VARCHAR) AS new FROM ev""",
    "sq, applied, ver, val, ex",
    "CAST(-1 AS BIGINT), false, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT)",
    """val IS NOT NULL AND (ex IS NULL OR t < ex) AS live, CASE kind WHEN 'error' THEN live WHEN 'purchase' THEN live WHEN 'click' THEN true ELSE NOT live END AS does""",
    """seq, does, CASE WHEN kind = 'error' THEN 0 ELSE CASE WHEN live THEN ver ELSE 0 END + CASE WHEN does THEN 1 ELSE 0 END END,
        CASE WHEN kind = 'error' THEN NULL WHEN does THEN new WHEN live THEN val END,
        CASE WHEN kind = 'error' THEN NULL WHEN kind = 'signup' AND does THEN t + k * 3600000000 WHEN does AND (kind = 'view' OR kind = 'click' AND k % 2 = 0) THEN NULL WHEN live THEN ex END""",
)


@query(recursion(*CONDITIONAL, 'SELECT key, sq AS seq, applied, ver AS version, val AS "value", ex AS expires_us FROM f WHERE n > 0'))
def conditional_sets(spark: SparkSession, d: str) -> DataFrame:
    """Always, IfAbsent and IfPresent sets that clear, keep or set the expiry; unmet ones change nothing."""
    return fold.conditional(S.conditional_log(spark, d))


@query(recursion(*CONDITIONAL, 'SELECT key, sq AS seq, ver AS version, val AS "value" FROM f WHERE n > 0 AND applied AND val IS NOT NULL'))
def conditional_sets_chunked(spark: SparkSession, d: str) -> DataFrame:
    """The values that applied conditional sets leave, stored as chunks under manifests and read back: the same as inline ones."""
    done = fold.conditional(S.conditional_log(spark, d)).where("applied and value is not null")
    return storage.through_chunks(done, 3).select("key", "seq", "version", "value")


@query(f"WITH {WRITES} SELECT key, seq, version, value FROM vs")
def set_chunked(spark: SparkSession, d: str) -> DataFrame:
    """Every set's value stored as chunks under a manifest and read back: versions and values are those of inline sets."""
    return storage.through_chunks(fold.versions(S.bytes_log(spark, d)), 3).select("key", "seq", "version", "value")


@query(
    recursion(
        """SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq) AS n, seq, now_us AS t, kind, CAST(cents AS VARCHAR) AS new, CASE WHEN kind = 'signup' THEN now_us + k * 3600000000 END AS till FROM ev WHERE kind IN ('signup', 'purchase', 'error')""",
        "sq, applied, val, ex",
        "CAST(-1 AS BIGINT), false, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT)",
        "val IS NOT NULL AND (ex IS NULL OR t < ex) AS live, kind <> 'error' AND NOT live AS does",
        "seq, does, CASE WHEN kind = 'error' THEN NULL WHEN does THEN new WHEN live THEN val END, CASE WHEN kind = 'error' THEN NULL WHEN does THEN till WHEN live THEN ex END",
        'SELECT key, sq AS seq, val AS "value" FROM f WHERE applied',
    )
)
def set_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """The sets of the bytes log as IfAbsent ones: those that apply. An unmet one does not renew the expiry."""
    log = S.bytes_log(spark, d).where(F.col("op").isin(*fold.WRITES))
    at = F.when(F.col("op") == "set_ex", F.col("expires_us"))
    log = log.withColumns({"condition": F.lit("IfAbsent"), "expiry": F.when(F.col("op") == "set_ex", "At").otherwise("Clear"), "at_us": at})
    log = log.withColumn("op", F.when(F.col("op") == "delete", "delete").otherwise("set"))
    done = fold.conditional(log).where("applied and value is not null")
    return done.select("key", "seq", "value")


@query(
    recursion(
        """SELECT key % 20 AS key, row_number() OVER (PARTITION BY key % 20 ORDER BY id) AS n, id, op, permit, key AS who, qty FROM (
            SELECT key, seq * 3 + 1 AS id, kind AS op, k AS qty, coalesce(last_value(CASE WHEN kind = 'click' THEN seq END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq), -1) AS permit FROM ev WHERE kind <> 'signup'
            UNION ALL SELECT key, seq * 3 + 2, 'click', k + CASE WHEN seq % 14 = 0 THEN 1 ELSE 0 END, seq FROM ev WHERE kind = 'click' AND seq % 7 = 0
            UNION ALL SELECT any_value(key), (min(seq) + 60) * 3, 'error', 0, 0 FROM ev WHERE kind <> 'signup' GROUP BY key % 20)""",
        "sq, status, released, used, cap, held",
        "CAST(-1 AS BIGINT), '', CAST(NULL AS BOOLEAN), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS STRUCT(p BIGINT, o BIGINT, q BIGINT)[])",
        """len(list_filter(held, lambda x: x.p = permit)) > 0 AS has, list_contains(held, {'p': permit, 'o': who, 'q': qty}) AS same, op = 'click' AND cap IS NOT NULL AND qty > 0 AND len(list_filter(held, lambda x: x.p = permit)) = 0 AND used + qty <= cap AS takes""",
        """id, CASE op WHEN 'error' THEN CASE WHEN cap IS NULL THEN 'Ok' ELSE 'WrongType' END WHEN 'purchase' THEN 'Ok' ELSE CASE WHEN cap IS NULL THEN 'NotFound' WHEN op = 'view' OR qty = 0 OR same OR takes THEN 'Ok' ELSE 'SemaphoreExhausted' END END,
        CASE WHEN op = 'purchase' THEN has END, CAST(CASE WHEN takes THEN used + qty WHEN op = 'purchase' AND has THEN used - list_filter(held, lambda x: x.p = permit)[1].q ELSE used END AS BIGINT),
        CASE WHEN op = 'error' AND cap IS NULL THEN 200 ELSE cap END,
        CASE WHEN takes THEN list_append(held, {'p': permit, 'o': who, 'q': qty}) WHEN op = 'purchase' THEN list_filter(held, lambda x: x.p <> permit) ELSE held END""",
        "SELECT key, sq AS seq, status, released, used, cap AS capacity FROM f WHERE n > 0",
    )
)
def semaphore_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return fold.semaphores(S.semaphore_log(spark, d))


@query(f'WITH {WRITES} SELECT key, value, version, expires_us FROM st')
def storage_recover(spark: SparkSession, d: str) -> DataFrame:
    """The state out of a checkpoint at event 5,000 and the log behind it: the same as from the whole log."""
    log = S.bytes_log(spark, d)
    return fold.recover(fold.latest(log.where("seq <= 5000")), log.where("seq > 5000"))


@query(f"""WITH {EVENTS}, bn AS (SELECT seq, CAST('0x' || substr(md5('1:' || key), 1, 2) AS BIGINT) AS band FROM ev WHERE kind IN ('signup', 'purchase', 'error') AND seq > 500)
    SELECT band, count(*) AS writes, max(seq) AS last_seq FROM bn GROUP BY ALL""")
def storage_dirty_bands(spark: SparkSession, d: str) -> DataFrame:
    """Bands, the top eight bits of the route hash, written since event 500."""
    log = S.bytes_log(spark, d).where(F.col("op").isin(*fold.WRITES))
    return storage.dirty_bands(log.withColumn("hash", directory.route_hash(1, F.col("key").cast("string"))), 500)


@query("SELECT o_custkey AS key, o_orderkey AS seq, 3 * (o_custkey % 100) - 2 * (o_orderkey % 50) + CAST(round(o_totalprice) AS BIGINT) % 1000 + 7 AS score FROM orders")
def linear_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a fixed linear model, inside the engine."""
    o = S.table(spark, d, "orders")
    features = F.array(F.col("o_custkey") % 100, F.col("o_orderkey") % 50, F.round(F.col("o_totalprice")).cast("long") % 1000)
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), fold.linear_score([3, -2, 1], 7, features).alias("score"))


@query(None)
def linear_taught(spark: SparkSession, d: str) -> DataFrame:
    """A model for each of 16 scopes, taught by its orders."""
    o = S.table(spark, d, "orders")
    features = F.array(F.col("o_custkey") % 10, F.col("o_orderkey") % 5, F.lit(1).cast("long"))
    return fold.taught(o.select((F.col("o_custkey") % 16).alias("key"), F.col("o_orderkey").alias("seq"), features.alias("features"), (F.col("o_custkey") % 10 * 40).alias("target")))


TYPES = "ty AS (SELECT c_custkey AS key, ['bytes', 'counter', 'bounded', 'stream'][c_custkey % 4 + 1] AS kind, c_name AS value, CAST(round(c_acctbal) AS BIGINT) AS number FROM customer WHERE c_custkey % 9 <> 0)"


@query(f"""WITH {TYPES}, rq AS (SELECT o_orderkey AS id, o_custkey + o_orderkey % 3 AS key, ['get', 'counter_get', 'bounded_get', 'stream_read', 'exists'][o_orderkey % 5 + 1] AS op, ['bytes', 'counter', 'bounded', 'stream', NULL][o_orderkey % 5 + 1] AS wants FROM orders)
    SELECT id, CASE WHEN op = 'exists' THEN 'Ok' WHEN kind IS NULL THEN CASE WHEN op = 'bounded_get' THEN 'BoundedExceeded' ELSE 'Ok' END WHEN kind <> wants THEN 'WrongType' ELSE 'Ok' END AS status,
        CASE WHEN op = 'exists' THEN CASE WHEN kind IS NULL THEN 'false' ELSE 'true' END WHEN kind <> wants OR kind IS NULL THEN NULL WHEN op = 'get' THEN value ELSE CAST(number AS VARCHAR) END AS answer FROM rq LEFT JOIN ty USING (key)""")
def typed_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads of objects of four types, many of the wrong one or of none."""
    pick = lambda names, at: F.element_at(F.array(*(F.lit(n) for n in names)), (at + 1).cast("int"))
    ops = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr("o_custkey + o_orderkey % 3").alias("key"), pick(["get", "counter_get", "bounded_get", "stream_read", "exists"], F.col("o_orderkey") % 5).alias("op"))
    return fold.typed_reads(ops, typed_state(spark, d))


def typed_state(spark: SparkSession, d: str) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, ("bytes", "counter", "bounded", "stream"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return S.table(spark, d, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("key"), pick.alias("kind"), F.col("c_name").alias("value"), F.round("c_acctbal").cast("long").alias("number"))


@query(f"WITH {TYPES} SELECT key, CASE kind WHEN 'bytes' THEN 'bytes:' || length(value) ELSE kind || ':' || number END AS descriptor FROM ty")
def scan_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """What a scan shows of typed objects: no bulk, only a length or a number."""
    return fold.descriptors(typed_state(spark, d))


@query(f"WITH {ENTRIES} SELECT key, (row_number() OVER (ORDER BY key) - 1) // 40 AS page FROM en QUALIFY row_number() OVER (ORDER BY key) <= 160")
def scan_pages(spark: SparkSession, d: str) -> DataFrame:
    """Four pages of 40, each resumed behind the last key of the one before."""
    return scan.pages(S.entries(spark, d), "order:", 40, 4).select("key", "page")


@query("""WITH tg AS (SELECT o_custkey % 6 AS lane, o_orderkey AS asset, CAST(round(o_totalprice) AS BIGINT) AS b FROM orders), cu AS (SELECT *, CAST(sum(b) OVER (PARTITION BY lane ORDER BY asset) AS BIGINT) AS e FROM tg),
    bt AS (SELECT lane, asset, e - b AS s, e, unnest(range((e - b) // 1000000, (e - 1) // 1000000 + 1)) AS batch FROM cu WHERE b > 0)
    SELECT lane, CAST(batch AS BIGINT) AS batch, asset, CAST(greatest(s, batch * 1000000) - s AS BIGINT) AS "offset", CAST(least(e, (batch + 1) * 1000000) - greatest(s, batch * 1000000) AS BIGINT) AS bytes FROM bt""")
def scrub_batches(spark: SparkSession, d: str) -> DataFrame:
    """Assets checked in batches of a million bytes for each of six lanes, ranges cut where a batch is full."""
    o = S.table(spark, d, "orders").select((F.col("o_custkey") % 6).alias("lane"), F.col("o_orderkey").alias("asset"), F.round("o_totalprice").cast("long").alias("bytes"))
    return control.scrub_batches(o, 1_000_000)


@query("""WITH fr AS (SELECT l_orderkey AS asset, l_suppkey % 5 AS domain, l_returnflag <> 'R' AS usable FROM lineitem),
    ag AS (SELECT asset, count(*) AS total, count(*) FILTER (usable) AS usable, greatest(count(DISTINCT domain) FILTER (usable) - 2, 0) AS indep FROM fr GROUP BY ALL),
    sv AS (SELECT *, least(indep, total - 2) AS survivable FROM ag WHERE total >= 3)
    SELECT asset, usable, survivable, CASE WHEN usable < 2 THEN 'Unrecoverable' WHEN total - 2 - survivable > 0 OR usable < total THEN CASE WHEN survivable = 0 THEN 'Critical' ELSE 'Degraded' END ELSE 'Healthy' END AS health FROM sv""")
def redundancy_health(spark: SparkSession, d: str) -> DataFrame:
    """Orders as assets of as many fragments as lines, two of which are needed, in five failure domains."""
    line = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset"), (F.col("l_suppkey") % 5).alias("domain"), (F.col("l_returnflag") != "R").alias("usable"))
    return control.redundancy(line, 2).where("total >= 3").drop("total")


@query(None)
def redundancy_placement(spark: SparkSession, d: str) -> DataFrame:
    """Six fragments of every part on 20 nodes in 8 racks."""
    nodes = spark.range(20).selectExpr("id as node", "concat('rack', id % 8) as domain")
    return control.spread(S.table(spark, d, "part").select(F.col("p_partkey").alias("asset")), nodes, 6)


@query("SELECT doc_id AS key, octet_length(encode(text)) AS bytes, sha256(encode(text)) AS digest FROM documents WHERE octet_length(encode(text)) > 0")
def erasure_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every document in four fragments and two of parity, reassembled from any four: which two are lost depends on its id."""
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").cast("binary").alias("value")).where("octet_length(value) > 0")
    coded = erasure.encode(docs, 4, 2)
    held = coded.where("fragment <> key % 6 and fragment <> (key div 6) % 6")
    back = erasure.decode(held, 4, 2)
    return back.select("key", F.octet_length("value").cast("long").alias("bytes"), F.sha2("value", 256).alias("digest"))


ORACLE_SQL["stream_outcomes"] = recursion(
    """SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS n FROM (
        SELECT user_id % 4 AS key, event_id * 3 + 2 AS id, 'append' AS op, greatest(length(CAST(user_id AS VARCHAR)), coalesce(octet_length(encode(props)), 0)) AS size FROM events
        UNION ALL SELECT user_id % 4, min(event_id) * 3, 'create', 0 FROM events GROUP BY user_id % 4
        UNION ALL SELECT user_id % 4, min(event_id) * 3 + 1, 'trim', 0 FROM events GROUP BY user_id % 4, epoch_us(ts) // 3600000000)""",
    "sq, what, status, off, gone, fst, nxt",
    "CAST(-1 AS BIGINT), '', '', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT)",
    "op = 'append' AND fst IS NOT NULL AND size <= 65536 AND nxt - fst < 1024 AS takes, least(greatest(fst, nxt - 49), nxt) AS kept",
    """id, op, CASE WHEN op = 'append' AND fst IS NULL THEN 'NotFound' WHEN op = 'append' AND NOT takes THEN 'StreamFull' WHEN op = 'create' AND fst IS NOT NULL THEN 'WrongType' ELSE 'Ok' END,
        CASE WHEN takes THEN nxt END, CASE WHEN op = 'trim' THEN coalesce(kept - fst, 0) END, CASE WHEN op = 'create' THEN coalesce(fst, 0) WHEN op = 'trim' THEN kept ELSE fst END, CASE WHEN takes THEN nxt + 1 ELSE nxt END""",
    'SELECT key AS shard, sq // 3 AS seq, what AS op, status, off AS "offset", gone AS removed, nxt AS next_offset, nxt - coalesce(fst, nxt) AS retained FROM f WHERE n > 0',
)
ORACLE_SQL["session_outcomes"] = recursion(
    """SELECT key, row_number() OVER (PARTITION BY key ORDER BY id) AS n, id, request, greatest(request - 8, 0) AS ack FROM (
        WITH rq AS (SELECT key % 40 AS key, seq, row_number() OVER (PARTITION BY key % 40 ORDER BY seq) AS request FROM ev WHERE kind IN ('click', 'purchase', 'error'))
        SELECT key, request, request * 2 AS id FROM rq UNION ALL SELECT key, request, (request + CASE WHEN seq % 2 = 1 THEN 0 ELSE 12 END) * 2 + 1 FROM rq WHERE seq % 11 = 0)""",
    "sq, status, answered, low, held",
    "CAST(-1 AS BIGINT), '', CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST([] AS STRUCT(r BIGINT, s BIGINT)[])",
    "request <= greatest(low, ack) AS late, list_filter(held, lambda x: x.r = request) AS hit, request > greatest(low, ack) AND len(list_filter(held, lambda x: x.r = request)) = 0 AND len(held) < 1024 AS runs",
    """id, CASE WHEN late THEN 'Expired' WHEN len(hit) > 0 THEN 'Replay' WHEN runs THEN 'Ok' ELSE 'Overloaded' END, CASE WHEN NOT late AND len(hit) > 0 THEN hit[1].s WHEN runs THEN id END,
        CASE WHEN runs THEN greatest(low, ack) ELSE low END, CASE WHEN runs THEN list_append(list_filter(held, lambda x: x.r > greatest(low, ack)), {'r': request, 's': id}) ELSE held END""",
    "SELECT key AS session, sq AS seq, status, answered, low AS floor FROM f WHERE n > 0",
)
ORACLE_SQL["escrow_outcomes"] = f"""WITH RECURSIVE {BOUNDED.replace("0 AND 500", "0 AND 400")} SELECT a.key AS donor, b.key AS recipient, CASE WHEN 400 - g < 0 OR a.value > 400 - g THEN 'Conflict' WHEN 400 + g > 500 THEN 'InvalidWrite' ELSE 'Ok' END AS status,
    CASE WHEN 400 - g >= a.value AND 400 + g <= 500 THEN 400 - g ELSE 400 END AS donor_max, CASE WHEN 400 - g >= a.value AND 400 + g <= 500 THEN 400 + g ELSE 400 END AS recipient_max
    FROM (SELECT *, (key + 1) * 50 AS g FROM bv) a JOIN bv b ON b.key = (a.key + 1) % 10"""
