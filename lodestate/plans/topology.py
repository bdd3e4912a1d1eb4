"""Queries over directories, plans and control decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestate.functions import dialect as D
from lodestate.operators import control, directory, planner
from lodestate.plans.oracles import ENTRIES, EVENTS, TELEMETRY
from lodestate.plans.typed import recursion
from lodestate.sources import oplog as S

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Six tiles as halving gives them: parents 1, 2, 3, 4 and 5 are retired on the way.
TILES = "tl(tablet, bits) AS (VALUES (6, '10'), (7, '11'), (8, '000'), (9, '001'), (10, '010'), (11, '011'))"
HASHED = f"""{ENTRIES}, {TILES}, hs AS (SELECT key, md5('7:' || key) AS hash FROM en), hb AS (SELECT *, lpad(bin(CAST('0x' || substr(hash, 1, 1) AS INTEGER)), 4, '0') AS b FROM hs)"""


@query(f"WITH {HASHED} SELECT key, hash, tablet FROM hb JOIN tl ON starts_with(b, bits)")
def route_hashed(spark: SparkSession, d: str) -> DataFrame:
    """Every entry's route hash and its tablet of a static tiling of six."""
    return directory.route_hashed(S.entries(spark, d).select("key"), directory.static_tiles(spark, 6), 7)


@query(f"WITH {TILES} SELECT a.tablet, b.tablet AS other, starts_with(a.bits, left(b.bits, 1)) AS overlaps, a.bits || '0' AS left_half, a.bits || '1' AS right_half FROM tl a CROSS JOIN (SELECT * FROM tl WHERE length(bits) = 3) b")
def hash_tile_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Each tile against the parents of the small ones, one bit long: overlaps; and its midpoint halves."""
    tiles = directory.static_tiles(spark, 6)
    other = tiles.where("length(bits) = 3").select(F.col("tablet").alias("other"), F.substring("bits", 1, 1).alias("parent"))
    pairs = tiles.crossJoin(F.broadcast(other))  # six tiles
    return pairs.select("tablet", "other", directory.hash_overlaps(F.col("bits"), F.col("parent")).alias("overlaps"), F.concat("bits", F.lit("0")).alias("left_half"), F.concat("bits", F.lit("1")).alias("right_half"))


def tiling(spark: SparkSession, d: str) -> DataFrame:
    """Tablets of 1,000 order keys each, from the empty key on, the last unbounded; every fourth is to be split (its halves n + 100,000
    and n + 200,000 wait inactive), every tablet n of n % 8 = 1 to be merged with the next one into n + 300,000; every 12th plan
    finds its tablet not fenced."""
    n = S.table(spark, d, "orders").select(F.expr("o_orderkey div 1000").alias("n")).distinct()
    top = n.agg(F.max("n").alias("top"))
    n = spark.range(1).join(F.broadcast(top)).select(F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("n"), "top")  # one row
    edge = lambda at: F.format_string("order:%010d", at * 1000)
    n = n.withColumns({"start_key": F.when(F.col("n") == 0, "").otherwise(edge(F.col("n"))), "end_key": F.when(F.col("n") < F.col("top"), edge(F.col("n") + 1))})
    fenced = (F.col("n") % 4 == 0) & (F.col("n") % 12 != 8) | (F.col("n") % 8).isin(1, 2) & (F.col("n") - F.col("n") % 8 + 2 <= F.col("top"))
    none = F.lit(None).cast("array<bigint>").alias("redirect")
    base = n.select(F.col("n").alias("tablet"), "start_key", "end_key", F.when(fenced, "Fenced").otherwise("Active").alias("state"), none)
    split = n.where("n % 4 = 0")
    middle = F.format_string("order:%010d", F.col("n") * 1000 + 500)
    left = split.select((F.col("n") + 100_000).alias("tablet"), "start_key", middle.alias("end_key"), F.lit("Inactive").alias("state"), none)
    right = split.select((F.col("n") + 200_000).alias("tablet"), middle.alias("start_key"), "end_key", F.lit("Inactive").alias("state"), none)
    merged = n.where("n % 8 = 1 and n + 1 <= top").select((F.col("n") + 300_000).alias("tablet"), "start_key", F.when(F.col("n") + 1 < F.col("top"), edge(F.col("n") + 2)).alias("end_key"), F.lit("Inactive").alias("state"), none)
    return base.unionByName(left).unionByName(right).unionByName(merged)


def published(spark: SparkSession, d: str) -> DataFrame:
    before = tiling(spark, d)
    splits = before.where("tablet < 100000 and tablet % 4 = 0").select(F.array("tablet").alias("parents"), F.array(F.col("tablet") + 100_000, F.col("tablet") + 200_000).alias("children"))
    merges = before.where("tablet >= 300000").select(F.array(F.col("tablet") - 300_000, F.col("tablet") - 299_999).alias("parents"), F.array("tablet").alias("children"))
    return directory.cutover(before, splits.unionByName(merges))


DIRECTORY = """tp AS (SELECT max(o_orderkey // 1000) AS top FROM orders), nn AS (SELECT n, top, CASE WHEN n = 0 THEN '' ELSE printf('order:%010d', n * 1000) END AS s, CASE WHEN n < top THEN printf('order:%010d', (n + 1) * 1000) END AS e
        FROM tp, LATERAL (SELECT unnest(range(0, top + 1)) AS n)),
    dr AS (
        SELECT n AS tablet, s AS start_key, e AS end_key, CASE WHEN n % 4 = 0 AND n % 12 <> 8 OR n % 8 IN (1, 2) AND n - n % 8 + 2 <= top THEN 'Tombstone' ELSE 'Active' END AS state,
            CASE WHEN n % 4 = 0 AND n % 12 <> 8 THEN (n + 100000) || ',' || (n + 200000) WHEN n % 8 IN (1, 2) AND n - n % 8 + 2 <= top THEN CAST(n - n % 8 + 300001 AS VARCHAR) END AS redirect FROM nn
        UNION ALL SELECT n + 100000, s, printf('order:%010d', n * 1000 + 500), CASE WHEN n % 12 = 8 THEN 'Inactive' ELSE 'Active' END, NULL FROM nn WHERE n % 4 = 0
        UNION ALL SELECT n + 200000, printf('order:%010d', n * 1000 + 500), e, CASE WHEN n % 12 = 8 THEN 'Inactive' ELSE 'Active' END, NULL FROM nn WHERE n % 4 = 0
        UNION ALL SELECT n + 300000, s, CASE WHEN n + 1 < top THEN printf('order:%010d', (n + 2) * 1000) END, 'Active', NULL FROM nn WHERE n % 8 = 1 AND n + 1 <= top)"""


@query(f"WITH {DIRECTORY} SELECT * FROM dr")
def directory_cutover(spark: SparkSession, d: str) -> DataFrame:
    """The directory after the splits and merges whose tablets are fenced."""
    return published(spark, d).withColumn("redirect", F.array_join("redirect", ","))


@query(f"""WITH {DIRECTORY} SELECT key, o_orderkey // 1000 AS tablet, tablet AS successor FROM (SELECT printf('order:%010d', o_orderkey) AS key, o_orderkey FROM orders)
    JOIN dr ON state = 'Active' AND key >= start_key AND (end_key IS NULL OR key < end_key) WHERE o_orderkey // 1000 IN (SELECT tablet FROM dr WHERE state = 'Tombstone')""")
def directory_redirects(spark: SparkSession, d: str) -> DataFrame:
    """The live successor of every order key whose old tablet is retired."""
    keys = S.table(spark, d, "orders").select(F.format_string("order:%010d", "o_orderkey").alias("key"), F.expr("o_orderkey div 1000").alias("tablet"))
    return directory.route_retired(keys, published(spark, d))


@query(f"""WITH {DIRECTORY}, bad AS (SELECT tablet, start_key, end_key, CASE WHEN tablet % 10 = 4 THEN 'Active' ELSE state END AS state, CASE WHEN tablet % 10 = 6 AND tablet < 100000 THEN '1' WHEN tablet % 10 = 4 THEN NULL WHEN tablet % 16 = 1 THEN NULL ELSE redirect END AS redirect FROM dr)
    SELECT tablet, CASE WHEN state = 'Tombstone' THEN 'RedirectMissing' ELSE 'UnexpectedRedirect' END AS problem FROM bad WHERE (state = 'Tombstone') <> (redirect IS NOT NULL)
    UNION ALL SELECT a.tablet, 'OverlappingActiveAuthority' FROM bad a WHERE state = 'Active' AND EXISTS (SELECT 1 FROM bad b WHERE b.state = 'Active' AND (b.start_key < a.start_key OR b.start_key = a.start_key AND b.tablet < a.tablet) AND (b.end_key IS NULL OR b.end_key > a.start_key))""")
def directory_violations(spark: SparkSession, d: str) -> DataFrame:
    """The problems of a directory with tablets made active again and redirects put and lost."""
    n, active = F.col("tablet") % 10, F.col("tablet") % 10 == 4
    redirect = F.when((n == 6) & (F.col("tablet") < 100_000), F.array(F.lit(1).cast("long"))).when(active | (F.col("tablet") % 16 == 1), F.lit(None)).otherwise(F.col("redirect"))
    return directory.violations(published(spark, d).withColumns({"state": F.when(active, "Active").otherwise(F.col("state")), "redirect": redirect}))


@query(f"WITH {DIRECTORY}, ac AS (SELECT * FROM dr WHERE state = 'Active') SELECT count(*) FILTER (start_key = '') = 1 AND count(*) FILTER (end_key IS NULL) = 1 AND bool_and(end_key IS NULL OR end_key IN (SELECT start_key FROM ac)) AND count(DISTINCT start_key) = count(*) AS complete FROM ac")
def directory_coverage(spark: SparkSession, d: str) -> DataFrame:
    return directory.coverage_complete(published(spark, d))


@query(f"""WITH {DIRECTORY}, ac AS (SELECT * FROM dr WHERE state = 'Active') SELECT a.tablet, b.tablet AS other, a.start_key, b.end_key FROM ac a JOIN ac b ON a.end_key = b.start_key""")
def directory_merge_pairs(spark: SparkSession, d: str) -> DataFrame:
    return directory.merge_pairs(published(spark, d).where("state = 'Active'"))


@query(f"""WITH {DIRECTORY} SELECT tablet, CASE WHEN printf('order:%010d', (tablet % 100000) * 1000 + 500) > start_key AND (end_key IS NULL OR printf('order:%010d', (tablet % 100000) * 1000 + 500) < end_key) THEN 'Ok' ELSE 'InvalidSplitKey' END AS status,
    CASE WHEN printf('order:%010d', (tablet % 100000) * 1000 + 500) > start_key AND (end_key IS NULL OR printf('order:%010d', (tablet % 100000) * 1000 + 500) < end_key) THEN printf('order:%010d', (tablet % 100000) * 1000 + 500) END AS split_key FROM dr WHERE state = 'Active'""")
def directory_split_at(spark: SparkSession, d: str) -> DataFrame:
    """Splits at each tablet's middle: halves made before have it at an edge, so it is not inside them."""
    return directory.split_at(published(spark, d).where("state = 'Active'"), F.format_string("order:%010d", F.col("tablet") % 100_000 * 1000 + 500))


@query("""SELECT l_orderkey AS tablet, CASE WHEN l_orderkey % 7 = 0 THEN 'Converging' WHEN up = 0 THEN 'Unavailable' WHEN up < least(3, n) OR up < n THEN 'UnderReplicated' WHEN up > 3 THEN 'OverReplicated' ELSE 'Healthy' END AS health
    FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS up FROM lineitem GROUP BY ALL)""")
def control_health(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tablets, their lines as voters, of which returned ones are not usable; every seventh has a live plan."""
    by = S.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("tablet")).agg(F.count(F.lit(1)).alias("desired"), F.count_if(F.col("l_returnflag") != "R").alias("usable"))
    return control.health(by.withColumn("live_plan", F.col("tablet") % 7 == 0), 3)


@query(
    """WITH RECURSIVE o AS (SELECT o_custkey % 20 AS lane, o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) AS b, o_orderkey % 9 * 20000 AS cpu,
        row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY substring(o_orderpriority, 1, 1) DESC, o_orderkey) AS n FROM orders),
    f(lane, n, id, admitted, ub, uo, uc) AS (
        SELECT DISTINCT lane, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM o
        UNION ALL SELECT lane, n, id, fits, ub + CASE WHEN fits THEN b ELSE 0 END, uo + CASE WHEN fits THEN 1 ELSE 0 END, uc + CASE WHEN fits THEN cpu ELSE 0 END
        FROM (SELECT o.*, ub, uo, uc, ub + b <= 5000000 AND uo + 1 <= 40 AND uc + cpu <= 4000000 AS fits FROM f JOIN o ON o.lane = f.lane AND o.n = f.n + 1)
    ) SELECT lane, id, admitted, ub AS used_bytes, uo AS used_ops FROM f WHERE n > 0"""
)
def control_budget(spark: SparkSession, d: str) -> DataFrame:
    """Moves by priority under a tick's limits of bytes, operations and CPU; refused ones are not charged."""
    o = S.table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("lane"), F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice")).cast("long").alias("bytes"), F.substring("o_orderpriority", 1, 1).alias("priority"), (F.col("o_orderkey") % 9 * 20_000).alias("cpu_ns"))
    return planner.budget(o)


def _phase_sql() -> str:
    kinds = {"split": planner.SPLIT, "merge": planner.MERGE, "migration": planner.MIGRATION}
    legal = [(k, a, b) for k, s in kinds.items() for a, b in [*zip(s, s[1:], strict=False), *((x, "Failed") for x in s[:-1])]] + [(k, "Fenced", "BaseSeeded") for k in ("split", "merge")]
    names = [(k, i, p) for k, s in kinds.items() for i, p in enumerate([*s, "Failed"])]
    return f"""WITH RECURSIVE {EVENTS}, lg(kind, a, b) AS (VALUES {', '.join(map(repr, legal))}), nm(kind, i, p) AS (VALUES {', '.join(map(repr, names))}),
        st AS (SELECT key, seq, CASE key % 3 WHEN 0 THEN 'split' WHEN 1 THEN 'merge' ELSE 'migration' END AS kind, row_number() OVER (PARTITION BY key ORDER BY seq) AS n, CASE WHEN k % 50 = 49 THEN 8 ELSE k % 3 END AS hop FROM ev),
        o AS (SELECT st.*, nm.p AS wanted FROM st JOIN nm ON nm.kind = st.kind AND nm.i = CASE WHEN hop = 8 THEN 8 ELSE least(7, (n + hop) // 3) END),
        f(key, n, seq, status, phase) AS (
            SELECT DISTINCT key, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', 'Planned' FROM o
            UNION ALL SELECT o.key, o.n, o.seq, CASE WHEN wanted = phase OR lg.a IS NOT NULL THEN 'Ok' ELSE 'IllegalTransition' END, CASE WHEN lg.a IS NOT NULL THEN wanted ELSE phase END
            FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1 LEFT JOIN lg ON lg.kind = o.kind AND a = phase AND b = wanted
        ) SELECT key, seq, status, phase FROM f WHERE n > 0"""


@query(_phase_sql())
def plan_phases(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as steps of a split, a merge or a migration: mostly forward, some skipping a phase, some failing."""
    from pyspark.sql import Window

    e = S.events(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("seq")))
    at = F.when(F.col("k") % 50 == 49, 8).otherwise(F.least(F.lit(7), F.expr("(n + k % 3) div 3"))).cast("int")
    names = lambda steps: F.array(*(F.lit(s) for s in [*steps, "Failed"]))
    kind = F.when(F.col("key") % 3 == 0, "split").when(F.col("key") % 3 == 1, "merge").otherwise("migration")
    steps = F.when(kind == "split", names(planner.SPLIT)).when(kind == "merge", names(planner.MERGE)).otherwise(names(planner.MIGRATION))
    return planner.phases(e.select("key", "seq", kind.alias("kind"), F.element_at(steps, at + 1).alias("wanted")))


FLAGS = """fg AS (SELECT scope, "window", sum(writes) >= 3 * sum(reads) AS memory_high, sum(writes) <= sum(reads) AS memory_low, bool_or(critical) AS criticality, sum(stall) > 150000 AS memory_bound, count(*) >= 4 AS migrated,
    max(latency_ns) > 400000000 AS latency_bad, sum(stall) > 60000 AS repair_debt, sum(reads) = 0 AS imbalance, bool_or(tail) AS many_hotspot, count(*) = 1 AS cold_large, max(stall) < 50000 AS hot_small FROM te GROUP BY ALL)"""


def _controller_sql() -> str:
    names = sorted({f for needs, _ in planner.RULES for f in needs})
    runs = ", ".join(f"n - coalesce(max(CASE WHEN NOT {f} THEN n END) OVER w, 0) AS {f}" for f in names)
    case = " ".join(f"WHEN {' AND '.join(f'{f} >= 3' for f in needs)} THEN '{does}'" for needs, does in planner.RULES)
    return f"""WITH {TELEMETRY}, {FLAGS}, nf AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY "window") AS n FROM fg),
        rn AS (SELECT scope, "window", {runs} FROM nf WINDOW w AS (PARTITION BY scope ORDER BY "window")) SELECT scope, "window", CASE {case} END AS action FROM rn"""


@query(_controller_sql())
def control_actions(spark: SparkSession, d: str) -> DataFrame:
    """The controller's action for every scope and window, from flags over its telemetry."""
    reads, writes, stall, n = F.sum("reads"), F.sum("writes"), F.sum("stall"), F.count(F.lit(1))
    flags = S.telemetry(spark, d).groupBy("scope", "window").agg(
        (writes >= 3 * reads).alias("memory_high"), (writes <= reads).alias("memory_low"), F.bool_or("critical").alias("criticality"), (stall > 150_000).alias("memory_bound"), (n >= 4).alias("migrated"),
        (F.max("latency_ns") > 400_000_000).alias("latency_bad"), (stall > 60_000).alias("repair_debt"), (reads == 0).alias("imbalance"), F.bool_or("tail").alias("many_hotspot"), (n == 1).alias("cold_large"), (F.max("stall") < 50_000).alias("hot_small"),
    )
    return planner.controller(flags)


@query(None)
def control_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Admission of actions, one for each event: its kind on the user modulo 40, hourly windows, one ledger for each of 8 controllers."""
    e = S.events(spark, d)
    target = F.col("key") % 40
    actions = e.select((F.col("key") % 8).alias("key"), "seq", F.concat_ws(":", "kind", target).alias("action"), F.expr("concat(key % 40, if(kind in ('view', 'click'), ':memory', ':move'))").alias("conflict"), F.expr(f"now_us div {8 * S.HOUR_US}").alias("window"))
    return planner.ledger(actions)


PLACEMENT = """ob AS (SELECT o_orderkey AS object, o_custkey % 100 / 100 AS pressure, CAST(o_orderkey % 50 AS DOUBLE) AS score, CAST(round(o_totalprice) AS BIGINT) * 100 AS size, 100 + o_custkey % 3 * 100 AS weight, o_orderkey % 11 * 1000 AS mc, o_orderkey % 4 AS cur, o_orderkey % 2 AS home, o_custkey * 7 % 3000 AS since FROM orders),
    pv(provider, lat, cost, node, hop) AS (VALUES (0, 100, 400, 0, 60), (1, 350, 120, 1, 90), (2, 9000, 6, 0, 200), (3, 80000, 1, 1, 300)),
    co AS (SELECT *, greatest(lat::DOUBLE, 1.0::DOUBLE) * (1 + pressure * 2) * (1 + ln(1 + (score + 1))) + size * cost * (weight / 100) * 1e-6::DOUBLE + mc / 10000 - CASE WHEN provider = cur THEN pressure * 1e6::DOUBLE ELSE 0 END + CASE WHEN node <> home THEN hop ELSE 0 END * (1 + pressure * 2) AS c FROM ob CROSS JOIN pv)"""


@query(f"""WITH {PLACEMENT}, bs AS (SELECT object, arg_min(provider, struct_pack(c := c, p := provider)) AS best, min(c) AS bc, min(c) FILTER (provider = cur) AS now, any_value(cur) AS cur, any_value(since) AS since FROM co GROUP BY object)
    SELECT object, CASE WHEN since >= 500 AND best <> cur AND (now <= 0 OR (now - bc) / now >= 0.1) THEN best ELSE cur END AS provider, CASE WHEN since < 500 THEN 'cooldown' WHEN best = cur THEN 'best' WHEN now > 0 AND (now - bc) / now < 0.1 THEN 'hysteresis' ELSE 'move' END AS reason FROM bs""")
def placement_choice(spark: SparkSession, d: str) -> DataFrame:
    """Where each order's object goes among four kinds of memory."""
    o = S.table(spark, d, "orders").selectExpr(
        "o_orderkey as object", "o_custkey % 100 / 100 as pressure", "cast(o_orderkey % 50 as double) as score", "cast(round(o_totalprice) as bigint) * 100 as size", "100 + o_custkey % 3 * 100 as weight",
        "o_orderkey % 11 * 1000 as move_cost", "o_orderkey % 4 as current", "o_orderkey % 2 as home", "o_custkey * 7 % 3000 as since_move",
    )
    devices = spark.sql("select * from values (0, 100, 400, 0, 60), (1, 350, 120, 1, 90), (2, 9000, 6, 0, 200), (3, 80000, 1, 1, 300) as t(provider, latency, byte_cost, node, hop)")
    return planner.place(o, devices).withColumn("provider", F.col("provider").cast("long"))


@query("""SELECT o_orderkey AS object, round((o_orderkey % 100 + o_custkey % 7) / least(greatest(CAST(o_custkey % 9 AS DOUBLE), 1.0), 64.0) * (0.1::DOUBLE + 0.9::DOUBLE * least(greatest(0.4::DOUBLE * least(greatest(o_orderkey % 13 / 10, 0), 1) + 0.4::DOUBLE * least(greatest(o_orderkey % 7 / 6, 0), 1) + 0.2::DOUBLE * least(greatest(o_orderkey % 3 / 2, 0), 1), 0), 1))
    * (1 + 8 / sqrt(CAST(greatest(o_custkey, 1) AS DOUBLE))), 6) AS score FROM orders""")
def access_criticality(spark: SparkSession, d: str) -> DataFrame:
    """Scores of made-up access patterns, to six places."""
    o = S.table(spark, d, "orders")
    e = lambda sql: F.expr(sql)
    score = planner.access_criticality(e("o_orderkey % 100"), e("o_custkey % 7"), e("cast(o_custkey % 9 as double)"), e("o_orderkey % 13 / 10"), e("o_orderkey % 7 / 6"), e("o_orderkey % 3 / 2"), F.col("o_custkey"))
    return o.select(F.col("o_orderkey").alias("object"), F.round(score, 6).alias("score"))


def clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """25 clusters (nations of customers): 7 nodes each in 3 domains, some failed or draining; orders' line suppliers as replicas."""
    nodes = spark.range(25 * 7).selectExpr(
        "id div 7 as cluster", "id % 7 as node", "case when (id * 5) % 11 = 0 then 'Unavailable' when (id * 3) % 13 = 0 then 'Draining' else 'Active' end as state", "concat('d', id % 3) as domain", "1 + id % 2 as weight"
    )
    o = S.table(spark, d, "orders").where("o_orderkey <= 2000")
    tablets = o.selectExpr("o_custkey % 25 as cluster", "o_orderkey as tablet", "array_distinct(array(o_orderkey % 7, (o_orderkey + 1 + o_custkey % 2) % 7, (o_custkey * 3) % 7)) as replicas", "o_orderkey % 10 = 0 as live")
    return nodes, tablets


@query(None)
def plan_rebalance(spark: SparkSession, d: str) -> DataFrame:
    return planner.moves(*clusters(spark, d), "rebalance")


@query(None)
def plan_drain(spark: SparkSession, d: str) -> DataFrame:
    return planner.moves(*clusters(spark, d), "drain")


@query(None)
def plan_repair(spark: SparkSession, d: str) -> DataFrame:
    return planner.moves(*clusters(spark, d), "repair")


@query("""WITH ct AS (SELECT tablet, o_ordered, objects, bytes, lead(objects) OVER (ORDER BY tablet) AS ro FROM (SELECT o_orderkey // 250 AS tablet, (o_orderkey // 250) % 3 <> 0 AS o_ordered, count(*) FILTER (o_orderkey % 17 <> 0 AND (o_orderkey // 250 % 5 <> 0 OR o_orderkey % 7 = 0)) AS objects,
        sum(CAST(round(o_totalprice) AS BIGINT)) FILTER (o_orderkey % 17 <> 0 AND (o_orderkey // 250 % 5 <> 0 OR o_orderkey % 7 = 0)) AS bytes FROM orders GROUP BY ALL))
    SELECT tablet, CASE WHEN CASE WHEN o_ordered THEN bytes >= 60000000 ELSE objects >= 233 END THEN 'Split' WHEN objects <= 60 AND ro <= 240 THEN 'Merge' ELSE 'Keep' END AS action FROM ct""")
def control_triggers(spark: SparkSession, d: str) -> DataFrame:
    """Tablets of 250 order keys: hash ones split by objects, ordered ones by bytes, small neighbours merge."""
    o = S.table(spark, d, "orders").withColumns({"tablet": F.expr("o_orderkey div 250"), "kept": F.expr("o_orderkey % 17 <> 0 and (o_orderkey div 250 % 5 <> 0 or o_orderkey % 7 = 0)")})
    by = o.groupBy("tablet").agg(F.count_if("kept").alias("objects"), F.sum(F.when(F.col("kept"), F.round(F.col("o_totalprice")).cast("long"))).alias("bytes"))
    return control.triggers(by.withColumn("ordered", F.col("tablet") % 3 != 0), 233, 60_000_000, 60, 240)


@query(f"""WITH {EVENTS}, iv AS (SELECT seq AS tablet, printf('k%08d', now_us // 60000000 % 100000000) AS s, printf('k%08d', now_us // 60000000 % 100000000 + k) AS e FROM ev WHERE kind = 'signup' AND k > 0)
    SELECT a.tablet, a.s AS start_key FROM iv a WHERE EXISTS (SELECT 1 FROM iv b WHERE (b.s < a.s OR b.s = a.s AND b.tablet < a.tablet) AND b.e > a.s)""")
def directory_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups as ranges of k minutes: those that begin before an earlier one has ended."""
    e = S.events(spark, d).where("kind = 'signup' and k > 0")
    key = lambda at: F.format_string("k%08d", at)
    minute = F.expr(f"now_us div {S.MINUTE_US} % 100000000")
    return directory.overlapping(e.select(F.col("seq").alias("tablet"), key(minute).alias("start_key"), key(minute + F.col("k")).alias("end_key")))
