"""Queries over indexes, batches, read contracts, commands and stored values, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestate.functions import dialect as D
from lodestate.operators import commands, contracts, index, scan, storage, txn
from lodestate.plans.oracles import BATCHES, ENTRIES, EVENTS, INDEX
from lodestate.plans.queries import batches, parts
from lodestate.plans.typed import recursion
from lodestate.sources import oplog as S
from lodestate.sources import workload

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


KEYS = """ik AS (SELECT o_orderkey, replace(o_orderpriority, '-', chr(0)) AS term, printf('order:%d', o_orderkey) AS prim FROM orders),
    ih AS (SELECT *, hex(encode('LODE-IDX1')) || printf('%016X', 2) || '00' || replace(replace(regexp_replace(hex(encode(term)), '(..)', '\\1 ', 'g'), '00 ', '00 FF '), ' ', '') || '00' AS prefix FROM ik)"""


@query(f"WITH {KEYS} SELECT o_orderkey, prefix || hex(encode(prim)) || '00' AS entry, prefix, left(prefix, length(prefix) - 2) || '01' AS successor FROM ih")
def index_entry_keys(spark: SparkSession, d: str) -> DataFrame:
    """Index keys of the orders' priorities, whose terms hold a NUL, with the bounds of each term's window."""
    term = F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit("\0"))
    prefix = D.term_prefix(F.lit(2), term)
    o = S.table(spark, d, "orders")
    return o.select("o_orderkey", D.index_key(F.lit(2), term, F.format_string("order:%d", "o_orderkey")).alias("entry"), prefix.alias("prefix"), D.prefix_successor(prefix).alias("successor"))


@query(f"""WITH {KEYS}, wd AS (SELECT o_orderkey, prefix AS a, CASE o_orderkey % 4 WHEN 0 THEN left(prefix, length(prefix) - 2) || '01' WHEN 1 THEN prefix || hex(encode(prim)) || '00' WHEN 2 THEN hex(encode('LODE-IDX1')) || printf('%016X', 2) || '00' || hex(encode('4-ZZ')) || '00' ELSE 'FF' END AS b FROM ih)
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'TermWindow' WHEN 2 THEN CASE WHEN a < b THEN 'TermRange' ELSE 'Scan' END ELSE 'Scan' END AS kind FROM wd""")
def index_windows(spark: SparkSession, d: str) -> DataFrame:
    """What scans between such keys ask the index for: a term, a range of terms, or just keys."""
    term = F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit("\0"))
    prefix = D.term_prefix(F.lit(2), term)
    end = (
        F.when(F.col("o_orderkey") % 4 == 0, D.prefix_successor(prefix)).when(F.col("o_orderkey") % 4 == 1, D.index_key(F.lit(2), term, F.format_string("order:%d", "o_orderkey")))
        .when(F.col("o_orderkey") % 4 == 2, D.term_prefix(F.lit(2), F.lit("4-ZZ"))).otherwise("FF")
    )
    return S.table(spark, d, "orders").select("o_orderkey", D.window_kind(prefix, end).alias("kind"))


def indexed_writes(spark: SparkSession, d: str) -> DataFrame:
    """Purchases and sign-ups set a user's value under two terms, errors delete it."""
    e = S.events(spark, d).where("kind in ('signup', 'purchase', 'error')")
    terms = F.when(F.col("kind") != "error", F.array(F.concat(F.lit("kind:"), "kind"), F.concat(F.lit("k:"), (F.col("k") % 5).cast("string"))))
    return e.select(F.col("key").alias("primary"), "seq", terms.alias("terms"))


INDEXED = EVENTS + """, iw AS (SELECT key, seq, kind, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS life, CASE WHEN kind <> 'error' THEN ['k:' || (k % 5), 'kind:' || kind] ELSE [] END AS terms FROM ev WHERE kind IN ('signup', 'purchase', 'error')),
    im AS (SELECT *, count(*) FILTER (kind <> 'error') OVER (PARTITION BY key, life ORDER BY seq) AS version, coalesce(lag(terms) OVER (PARTITION BY key ORDER BY seq), []) AS old FROM iw)"""


@query(f"""WITH {INDEXED} SELECT seq, key AS "primary", version, array_to_string(terms, ',') AS put, array_to_string(list_filter(old, lambda t: NOT list_contains(terms, t)), ',') AS gone FROM im""")
def index_maintained(spark: SparkSession, d: str) -> DataFrame:
    """What each indexed write puts into the index and takes out, with the primary's version."""
    return index.maintained(indexed_writes(spark, d)).withColumns({c: F.array_join(c, ",") for c in ("put", "gone")})


@query(f"""WITH {INDEXED} SELECT unnest(terms) AS term, key AS "primary", version FROM (SELECT * FROM im QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)""")
def index_after(spark: SparkSession, d: str) -> DataFrame:
    return index.entries_after(indexed_writes(spark, d))


@query("SELECT o_orderkey AS seq, CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'Ok' ELSE 'UniqueViolation' END AS status FROM orders")
def index_unique_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return index.unique_outcomes(S.table(spark, d, "orders").select(F.col("o_custkey").alias("term"), F.col("o_orderkey").alias("primary"), F.col("o_orderkey").alias("seq")))


@query(f"""WITH {ENTRIES}, uq AS (SELECT o_custkey AS term, min(o_orderkey) AS id FROM orders GROUP BY ALL)
    SELECT c_custkey AS term, en.key AS "primary" FROM customer LEFT JOIN uq ON term = c_custkey LEFT JOIN en ON en.id = uq.id AND en.version = 1""")
def index_equal_unique(spark: SparkSession, d: str) -> DataFrame:
    """The owner of every customer's key in a unique index built while all versions were 1."""
    first = S.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("term")).agg(F.min("o_orderkey").alias("id"))
    entries = first.select("term", F.format_string("order:%010d", "id").alias("primary"), F.lit(1).cast("long").alias("version"))
    return index.equal_unique(S.table(spark, d, "customer").select(F.col("c_custkey").alias("term")), entries, S.entries(spark, d))


@query(f"WITH {INDEX} SELECT key, value FROM en JOIN ix ON key = prim AND ix.version = en.version")
def index_resolve_values(spark: SparkSession, d: str) -> DataFrame:
    """The values behind the index's hits; primaries written since are left out."""
    return index.resolve_values(S.index_entries(spark, d).select(F.col("primary").alias("key"), "version"), S.entries(spark, d))


@query(
    recursion(
        "SELECT key % 40 AS key, row_number() OVER (PARTITION BY key % 40 ORDER BY seq) AS n, seq, CASE kind WHEN 'signup' THEN 'create' WHEN 'view' THEN 'ready' WHEN 'click' THEN 'drop' ELSE 'remove' END AS step FROM ev",
        "sq, status, st", "CAST(-1 AS BIGINT), '', CAST(NULL AS VARCHAR)",
        """CASE WHEN step = 'create' AND st IS NULL THEN 'Building' WHEN step = 'ready' AND st = 'Building' THEN 'Ready' WHEN step = 'drop' AND st IN ('Building', 'Ready') THEN 'Dropping' WHEN step = 'remove' AND st = 'Dropping' THEN '' END AS nx""",
        "seq, CASE WHEN nx IS NULL THEN 'IllegalTransition' ELSE 'Ok' END, CASE WHEN nx IS NULL THEN st ELSE nullif(nx, '') END",
        "SELECT key, sq AS seq, status, st AS state FROM f WHERE n > 0",
    )
)
def index_catalog(spark: SparkSession, d: str) -> DataFrame:
    step = F.when(F.col("kind") == "signup", "create").when(F.col("kind") == "view", "ready").when(F.col("kind") == "click", "drop").otherwise("remove")
    return index.catalog(S.events(spark, d).select((F.col("key") % 40).alias("key"), "seq", step.alias("step")))


@query(f"""WITH {BATCHES}, rt AS (SELECT txn, key, max(route % 40) AS tablet FROM ba GROUP BY ALL), vt AS (SELECT ck.txn, tablet, bool_and(ok) AS yes FROM ck JOIN rt ON rt.txn = ck.txn AND rt.key = ck.key GROUP BY ALL),
    al AS (SELECT *, min(tablet) OVER w AS coordinator, bool_and(yes) OVER w AS every, count(*) OVER w AS n FROM vt WINDOW w AS (PARTITION BY txn))
    SELECT txn, tablet, coordinator, CASE WHEN n > 6 THEN NULL WHEN yes THEN 'Prepared' ELSE 'Conflict' END AS vote, CASE WHEN n > 6 THEN 'Rejected' WHEN every THEN 'Committed' ELSE 'Aborted' END AS decision,
        CASE WHEN n > 6 THEN NULL WHEN every THEN 'Finalize' WHEN yes THEN 'Release' END AS action FROM al""")
def txn_two_phase(spark: SparkSession, d: str) -> DataFrame:
    """Orders as batches over 40 tablets, at most 6 of them."""
    return txn.two_phase(batches(spark, d), parts(spark, d), 40, 6)


@query(f"""WITH {EVENTS}, op AS (SELECT key, seq, seq // 500 AS batch, CASE WHEN kind IN ('signup', 'purchase') THEN cents END AS v, kind FROM ev WHERE kind IN ('signup', 'purchase', 'view')),
    st AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY key, batch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS staged FROM op)
    SELECT seq, coalesce(staged, committed) AS own, committed FROM (SELECT seq, staged, (SELECT arg_max(w.v, w.seq) FROM op w WHERE w.key = st.key AND w.batch < st.batch AND w.v IS NOT NULL) AS committed FROM st WHERE v IS NULL)""")
def txn_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Views inside batches of 500 events: what the batch sees and what others see."""
    e = S.events(spark, d).where("kind in ('signup', 'purchase', 'view')")
    return txn.overlay(e.select("key", F.expr("seq div 500").alias("batch"), "seq", F.when(F.col("kind") != "view", F.col("cents")).alias("value")))


def serial_batches(spark: SparkSession, d: str) -> DataFrame:
    """Orders as batches in 40 partitions: each line puts, adds, adds within bounds or deletes, some expecting what they found before."""
    line = S.table(spark, d, "lineitem")
    kind = F.expr("case l_linenumber % 4 when 0 then 'Put' when 1 then 'CounterAdd' when 2 then 'BoundedAdd' else 'Delete' end")
    expect = F.expr("case when l_orderkey % 6 = 0 then 'Absent' when l_orderkey % 7 = 0 then 'Version' else 'Any' end")
    write = F.struct(
        F.col("l_linenumber").alias("ord"), (F.col("l_partkey") % 50).alias("key"), kind.alias("kind"), F.col("l_quantity").cast("long").alias("amount"), F.lit(60).cast("long").alias("bound"),
        expect.alias("expect"), F.expr("l_orderkey % 3").alias("expect_version"), F.lit(16).cast("long").alias("bytes"),
    )
    return line.groupBy((F.col("l_orderkey") % 40).alias("key"), F.col("l_orderkey").alias("seq")).agg(F.array_sort(F.collect_list(write)).alias("writes"))


@query(None)
def txn_serial(spark: SparkSession, d: str) -> DataFrame:
    """The status of every batch, each run over what those before it left."""
    return txn.serial(serial_batches(spark, d))


@query(f"""WITH {EVENTS}, rc AS (SELECT key % 8 AS lane, now_us AS proven, seq - seq % 7 AS position, seq // 3000 AS authority, key % 5 AS incarnation FROM ev WHERE seq % 9 = 0),
    rd AS (SELECT key % 8 AS lane, now_us, seq AS id, k * 60000000 AS age, seq // 3000 AS authority, key % 2 AS incarnation, seq - 40 + k AS applied FROM ev WHERE seq % 9 <> 0),
    fd AS (SELECT rd.*, rc.* EXCLUDE (lane, authority, incarnation), rc.authority AS ra, rc.incarnation AS ri FROM rd ASOF LEFT JOIN rc ON rd.lane = rc.lane AND now_us >= proven)
    SELECT id, CASE WHEN ok THEN 'Ok' ELSE 'Escalate' END AS status, CASE WHEN ok THEN position END AS position FROM (SELECT *, coalesce(now_us - proven <= age AND authority = ra AND incarnation = ri AND position <= applied, false) AS ok FROM fd)""")
def read_bounded_stale(spark: SparkSession, d: str) -> DataFrame:
    """Reads on eight lanes against receipts every ninth event; authorities change every 3,000 events."""
    e = S.events(spark, d).withColumns({"lane": F.col("key") % 8, "authority": F.expr("seq div 3000")})
    receipts = e.where("seq % 9 = 0").select("lane", F.col("now_us").alias("proven_us"), F.expr("seq - seq % 7").alias("position"), "authority", F.expr("key % 5").alias("incarnation"))
    reads = e.where("seq % 9 <> 0").select("lane", "now_us", F.col("seq").alias("id"), (F.col("k") * S.MINUTE_US).alias("max_age_us"), "authority", F.expr("key % 2").alias("incarnation"), (F.col("seq") - 40 + F.col("k")).alias("applied"))
    return contracts.bounded_stale(reads, receipts)


@query(f"""WITH {EVENTS}, al AS (SELECT key % 8 AS lane, max(seq) AS applied FROM ev GROUP BY ALL) SELECT seq AS id, CASE WHEN applied IS NULL THEN 'Unavailable' WHEN k % 4 = 0 AND seq % 2 = 0 AND applied - seq < 3000 THEN 'Cache' ELSE 'Local' END AS path, applied AS position FROM ev LEFT JOIN al ON lane = key % 10 WHERE kind = 'view'""")
def read_any(spark: SparkSession, d: str) -> DataFrame:
    """Views without a claim; some hold an answer cached at the applied position, some an older one."""
    e = S.events(spark, d)
    applied = e.groupBy((F.col("key") % 8).alias("lane")).agg(F.max("seq").alias("applied"))
    reads = e.where("kind = 'view'").select(F.col("seq").alias("id"), (F.col("key") % 10).alias("lane"), "k")
    fresh = F.when((F.col("k") % 4 == 0) & (F.col("id") % 2 == 0), F.when(F.col("applied") - F.col("id") < 3000, F.col("applied")).otherwise(F.col("id") - 1))
    cached = reads.join(applied, "lane", "left").select("id", "lane", fresh.alias("cached"))
    return contracts.any_state(cached, applied)


COMMANDS = EVENTS + """, cm AS (SELECT seq, now_us, kind, k, CASE kind WHEN 'signup' THEN k % 6 ELSE k % 8 END AS m FROM ev)"""


def argvs(spark: SparkSession, d: str) -> DataFrame:
    """Commands as text: SETs with options good and bad, expiries of both signs, reads, splices, and what is not supported."""
    word = lambda *w: F.array(*(x if not isinstance(x, str) else F.lit(x) for x in w))
    k, key, m = F.col("k").cast("string"), F.concat(F.lit("u"), F.col("key").cast("string")), F.col("m")
    sets = [word("SET", key, "v", "EX", k), word("set", key, "v", "nx", "px", k), word("SET", key, "v", "KEEPTTL", "XX"), word("SET", key, "v", "NX", "XX"), word("SET", key, "v", "EX", k, "KEEPTTL"), word("SET", key, "v", "PXAT", "soon")]
    rest = [word("EXPIRE", key, k), word("PEXPIREAT", key, F.concat(F.lit("-"), k)), word("EXPIRE", key, k, "NX"), word("STRLEN", key), word("SETRANGE", key, "2", ""), word("SETRANGE", key, "2", "ab"), word("INCR", key), word("PING")]
    pick = lambda options: F.element_at(F.array(*options), (m + 1).cast("int"))
    argv = F.when(F.col("kind") == "signup", pick(sets)).when(F.col("kind") == "error", word("FLUSHALL")).otherwise(pick(rest))
    e = S.events(spark, d).withColumn("m", F.when(F.col("kind") == "signup", F.col("k") % 6).otherwise(F.col("k") % 8))
    return e.select("seq", "now_us", argv.alias("argv"))


@query(f"""WITH {COMMANDS} SELECT seq,
    CASE WHEN kind = 'signup' THEN CASE m WHEN 0 THEN CASE WHEN k = 0 THEN 'InvalidExpire' ELSE 'Ok' END WHEN 1 THEN 'Ok' WHEN 2 THEN 'Ok' WHEN 5 THEN 'InvalidExpire' ELSE 'SyntaxError' END
        WHEN kind = 'error' THEN 'UnknownCommand' ELSE CASE m WHEN 2 THEN 'SyntaxError' WHEN 6 THEN 'Unsupported' WHEN 7 THEN 'Session' ELSE 'Ok' END END AS status,
    CASE WHEN kind = 'signup' THEN CASE WHEN m < 3 AND NOT (m = 0 AND k = 0) THEN 'set' END WHEN kind = 'error' THEN NULL ELSE CASE m WHEN 0 THEN 'expire_at' WHEN 1 THEN 'expire_at' WHEN 3 THEN 'length' WHEN 4 THEN 'length' WHEN 5 THEN 'set_range' END END AS op,
    CASE WHEN kind = 'signup' THEN CASE m WHEN 0 THEN CASE WHEN k > 0 THEN 'Always' END WHEN 1 THEN 'IfAbsent' WHEN 2 THEN 'IfPresent' END END AS condition,
    CASE WHEN kind = 'signup' THEN CASE m WHEN 0 THEN CASE WHEN k > 0 THEN 'At' END WHEN 1 THEN 'At' WHEN 2 THEN 'Keep' END END AS expiry,
    CASE WHEN kind = 'signup' THEN CASE WHEN m = 0 AND k > 0 THEN now_us + k * 1000000 WHEN m = 1 THEN now_us + k * 1000 END WHEN kind <> 'error' THEN CASE m WHEN 0 THEN now_us + k * 1000000 WHEN 1 THEN -k * 1000 END END AS at_us FROM cm""")
def command_operations(spark: SparkSession, d: str) -> DataFrame:
    return commands.translate(argvs(spark, d)).select("seq", "status", "op", "condition", "expiry", "at_us")


@query("SELECT doc_id AS key, octet_length(encode(text)) AS bytes, sha256(encode(text)) AS digest, true AS verified FROM documents WHERE octet_length(encode(text)) > 0")
def storage_reassembly(spark: SparkSession, d: str) -> DataFrame:
    """Every document reassembled from its chunks in order, and whether that is what its manifest was made of."""
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("value"))
    cut = storage.chunks(docs, 1024)
    whole = storage.reassemble(cut)
    proven = whole.select("key", F.octet_length("value").cast("long").alias("bytes"), "digest").join(docs.select("key", F.sha2(F.col("value").cast("binary"), 256).alias("expected")), "key")
    return proven.select("key", "bytes", "digest", (F.col("digest") == F.col("expected")).alias("verified"))


@query("SELECT DISTINCT l_suppkey AS pack FROM lineitem WHERE l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_partkey % 997 = 0)")
def storage_garbage(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as packs of parts, of which few are reachable."""
    line = S.table(spark, d, "lineitem")
    return storage.garbage(line.select(F.col("l_suppkey").alias("pack"), F.col("l_partkey").alias("digest")), line.where("l_partkey % 997 = 0").select(F.col("l_partkey").alias("digest")))


@query(f"WITH {ENTRIES} SELECT key, CASE WHEN length(value) <= 5 THEN 'Ok' ELSE 'Oversize' END AS status, length(value) AS total FROM en ORDER BY key LIMIT 1")
def scan_oversize(spark: SparkSession, d: str) -> DataFrame:
    """A page whose first value alone is over the byte budget of 5."""
    return scan.within_budget(scan.scan_range(S.entries(spark, d), "order:0000000000", None, 10), 5)


@query(f"WITH {ENTRIES} SELECT key, version, hex(encode(value)) AS value_hex FROM en")
def snapshot_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The whole keyspace in key order; written out, partitions are ranges."""
    return S.entries(spark, d).select("key", "version", F.hex(F.encode("value", "UTF-8")).alias("value_hex")).orderBy("key")


@query("""WITH op AS (SELECT unnest(range(0, 2000)) AS i), mx AS (SELECT * FROM op CROSS JOIN (VALUES ('get'), ('set'), ('counter'), ('mixed'), ('cache'), ('read_heavy'), ('balanced'), ('delete'), ('exists'), ('compat'), ('range')) t(mix))
    SELECT mix, i, CASE mix WHEN 'get' THEN 'get' WHEN 'set' THEN 'set' WHEN 'counter' THEN 'counter_add' WHEN 'delete' THEN 'delete' WHEN 'exists' THEN 'exists' WHEN 'range' THEN 'get_range'
        WHEN 'mixed' THEN ['get', 'set', 'counter_add', 'delete'][i % 4 + 1] WHEN 'compat' THEN ['get', 'set', 'expire', 'ttl', 'set_range'][i % 5 + 1]
        WHEN 'cache' THEN CASE WHEN i % 20 < 12 THEN 'get' WHEN i % 20 < 16 THEN 'exists' WHEN i % 20 < 19 THEN 'get_range' ELSE 'ttl' END
        WHEN 'read_heavy' THEN CASE WHEN i % 20 < 14 THEN 'get' WHEN i % 20 < 17 THEN 'exists' WHEN i % 20 < 19 THEN 'get_range' ELSE 'set' END
        ELSE CASE WHEN i % 20 < 4 THEN 'get' WHEN i % 20 < 8 THEN 'set' WHEN i % 20 < 11 THEN 'delete' WHEN i % 20 < 14 THEN 'exists' WHEN i % 20 < 16 THEN 'get_range' WHEN i % 20 = 16 THEN 'set_range' WHEN i % 20 = 17 THEN 'expire' ELSE 'ttl' END END AS op,
        CASE mix WHEN 'counter' THEN 'g:c' WHEN 'mixed' THEN CASE WHEN i % 4 = 2 THEN 'g:c' ELSE 'g' || (i % 64) END ELSE 'g' || (i % 64) END AS key FROM mx""")
def workload_operations(spark: SparkSession, d: str) -> DataFrame:
    """2,000 operations of each mix over 64 keys that all threads share."""
    import functools

    return functools.reduce(DataFrame.unionByName, (workload.operations(spark, mix, 2000, 64).select(F.lit(mix).alias("mix"), "i", "op", "key") for mix in workload.MIXES))


@query("SELECT c_custkey, substring(sha256(c_custkey % 7 || ':' || c_custkey || ':' || c_nationkey), 1, 32) AS id FROM customer")
def derived_ids(spark: SparkSession, d: str) -> DataFrame:
    """128-bit identities of (session, sequence, attempt): the same inputs give the same id."""
    c = S.table(spark, d, "customer")
    return c.select("c_custkey", D.derived_id(F.col("c_custkey") % 7, F.col("c_custkey"), F.col("c_nationkey")).alias("id"))
