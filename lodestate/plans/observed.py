"""Queries over signal families, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestate.operators import fold, observed
from lodestate.plans.oracles import TELEMETRY
from lodestate.sources import oplog as S

QUERIES, ORACLE_SQL = {}, {}

SIGNALS = """sg AS (SELECT *, p50 + o_custkey % 500 AS p99, p50 + o_custkey % 500 + 7 AS p999 FROM (SELECT o_custkey, o_custkey % 8 AS scope, o_orderkey AS sequence, o_orderkey % 97 AS depth, c % 1000 AS p50, o_orderkey % 3 AS rej, c % 10000 AS cpu, c % 30000 + 1 AS svc,
    c % 1000000 AS res, c % 2000000 AS logi, o_orderkey % 101 AS pct, o_orderkey % 5 AS att, o_orderkey % 2 AS fail, c AS mb, c % 70000 AS lag1, c % 90000 AS lag2 FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)))"""


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def signals(select: str) -> str:
    return f"WITH {SIGNALS} SELECT scope, {select} FROM sg GROUP BY scope"


@query(f"WITH {TELEMETRY}" + """ SELECT scope, "window", (sum(reads) + sum(writes))::DOUBLE / (sum(1000000 * (1 + sequence % 60)) / 1000000) AS requests_per_second, sum(reads)::DOUBLE / (sum(1000000 * (1 + sequence % 60)) / 1000000) AS reads_per_second,
    sum(writes)::DOUBLE / (sum(1000000 * (1 + sequence % 60)) / 1000000) AS writes_per_second, sum(reads) / nullif(sum(reads) + sum(writes), 0) AS read_ratio FROM te GROUP BY ALL""")
def telemetry_rates(spark: SparkSession, d: str) -> DataFrame:
    """Requests per second; a sample covers 1 to 60 seconds."""
    return observed.request_rates(S.telemetry(spark, d).withColumn("period_us", 1_000_000 * (1 + F.col("sequence") % 60)))


@query(f"WITH {TELEMETRY}" + """, a AS (SELECT scope, sequence AS arrival, CASE WHEN sequence % 13 = 0 THEN sequence - 40 ELSE sequence END AS s FROM te),
    b AS (SELECT *, max(s) OVER (PARTITION BY scope ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM a)
    SELECT scope, arrival, s AS sequence FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY arrival) AS n FROM b WHERE best IS NULL OR s > best) WHERE n <= 500""")
def telemetry_collect(spark: SparkSession, d: str) -> DataFrame:
    """What scopes of 500 samples take where every 13th sample comes with an old sequence."""
    t = S.telemetry(spark, d).withColumn("arrival", F.col("sequence")).withColumn("sequence", F.when(F.col("sequence") % 13 == 0, F.col("sequence") - 40).otherwise(F.col("sequence")))
    return observed.collect(t, 500).select("scope", "arrival", "sequence")


@query(signals("max(depth) AS max_depth, sum(p50) / count(*) AS mean_wait_p50, sum(p99) / count(*) AS mean_wait_p99, sum(p999) / count(*) AS mean_wait_p999, sum(rej)::BIGINT AS rejections"))
def telemetry_queueing(spark: SparkSession, d: str) -> DataFrame:
    return observed.queueing(S.signals(spark, d))


@query(signals("sum(cpu) / count(*) AS mean_cpu, sum(svc) / count(*) AS mean_service, sum(cpu) / sum(svc) AS cpu_to_service"))
def telemetry_compute(spark: SparkSession, d: str) -> DataFrame:
    return observed.compute(S.signals(spark, d))


@query(signals("arg_max(res, sequence) AS resident_bytes, arg_max(logi, sequence) AS logical_bytes, arg_max(res, sequence) / nullif(arg_max(logi, sequence), 0) AS residency_ratio"))
def telemetry_memory(spark: SparkSession, d: str) -> DataFrame:
    return observed.memory(S.signals(spark, d))


@query(signals("sum(pct) / (100 * count(*)) AS mean_pressure, sum(att)::BIGINT AS attempts, sum(fail)::BIGINT AS failures"))
def telemetry_memory_pressure(spark: SparkSession, d: str) -> DataFrame:
    return observed.memory_pressure(S.signals(spark, d))


@query(signals("sum(mb)::BIGINT AS bytes, count(*) AS operations, sum(cpu)::BIGINT AS cpu_ns, sum(svc)::BIGINT AS io_ns, sum(cpu) / sum(mb) AS cpu_ns_per_byte, sum(svc) / sum(mb) AS io_ns_per_byte"))
def telemetry_migration_cost(spark: SparkSession, d: str) -> DataFrame:
    return observed.migration_cost(S.signals(spark, d))


@query(signals("sum(res)::BIGINT AS received, sum(logi)::BIGINT AS transmitted, sum(lag1)::BIGINT AS storage_read, sum(lag2)::BIGINT AS storage_written, sum(cpu)::BIGINT AS storage_synced"))
def telemetry_io_bytes(spark: SparkSession, d: str) -> DataFrame:
    return observed.io_bytes(S.signals(spark, d))


@query(signals("sum(lag1) / count(*) AS mean_commit_lag, max(lag1) AS max_commit_lag, sum(lag2) / count(*) AS mean_replica_lag, max(lag2) AS max_replica_lag"))
def telemetry_consensus_lag(spark: SparkSession, d: str) -> DataFrame:
    return observed.consensus_lag(S.signals(spark, d))


@query(signals("""max(lag1) AS checkpoint_bytes, max(depth) AS checkpoint_age, max(att) AS repair_assets, max(lag2) AS repair_bytes, max(pct) AS repair_age, max(p50) AS scrub_bytes, max(p99) AS scrub_age,
    max(logi + svc) AS physical_bytes, max(res) AS stored_bytes, max(rej) AS fragments, max(fail) AS degraded_assets, max(logi + svc) / max(res) AS amplification"""))
def telemetry_peaks(spark: SparkSession, d: str) -> DataFrame:
    return observed.peaks(S.signals(spark, d))


@query(f"""WITH {SIGNALS}, rc AS (SELECT * FROM sg QUALIFY row_number() OVER (PARTITION BY scope ORDER BY sequence DESC) <= 128)
    SELECT scope, n, p50, p99, p999, max, promoted_bytes FROM (SELECT scope, count(*) AS n, quantile_disc(svc, 0.5) AS p50, quantile_disc(svc, 0.99) AS p99, quantile_disc(svc, 0.999) AS p999, max(svc) AS max FROM rc GROUP BY scope)
    JOIN (SELECT scope, sum(mb)::BIGINT AS promoted_bytes FROM sg GROUP BY scope) USING (scope)""")
def telemetry_offcore(spark: SparkSession, d: str) -> DataFrame:
    return observed.offcore(S.signals(spark, d), 128)


TOPOLOGY = "arg_max(depth + p50, sequence) / nullif(arg_max(depth, sequence), 0) AS worker_max_to_mean, arg_max(p99, sequence) / nullif(arg_max(p50, sequence), 0) AS tablet_max_to_mean"


@query(signals(TOPOLOGY))
def telemetry_topology(spark: SparkSession, d: str) -> DataFrame:
    return observed.topology(S.signals(spark, d))


@query(f"""WITH {SIGNALS}, hk AS (SELECT scope, CASE WHEN scope = 3 THEN 3 ELSE o_custkey % (scope * 60 + 9) END AS item, count(*) AS hits FROM sg GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY hits DESC, item) AS rank FROM hk),
    kk AS (SELECT scope, count(*) AS keys, max(hits) AS top1, sum(hits) AS total, sum(hits) FILTER (rank <= 10) AS top10, max(hits) > 1 AND max(hits) * 100 >= sum(hits) AS hot FROM rk GROUP BY scope),
    ss AS (SELECT scope, arg_max(res, sequence) AS resb, arg_max(logi, sequence) AS logb, trunc(sum(pct) / (100 * count(*)) * 1000000)::BIGINT AS pressure_ppm, sum(lag1) + sum(lag2) AS io, {TOPOLOGY} FROM sg GROUP BY scope),
    al AS (SELECT *, trunc(top1 / total * 1000000)::BIGINT AS top_key_ppm, trunc(top10 / total * 1000000)::BIGINT AS top_ten_ppm FROM ss JOIN kk USING (scope))
    SELECT scope, pressure_ppm, coalesce(trunc(worker_max_to_mean * 1000000)::BIGINT, 0) AS worker_imbalance_ppm, coalesce(trunc(tablet_max_to_mean * 1000000)::BIGINT, 0) AS tablet_imbalance_ppm, top_key_ppm, top_ten_ppm,
        keys = 1 AND top_key_ppm >= 900000 AS single_hot_key, keys >= 2 AND top_ten_ppm >= 500000 AS many_key_hotspot, resb >= 1000000 OR pressure_ppm >= 750000 AS memory_hotspot, io >= 1000000 AS storage_hotspot,
        logb >= 1000000 AND NOT hot AS cold_large, logb <= 1000000 AND hot AS hot_small FROM al""")
def telemetry_features(spark: SparkSession, d: str) -> DataFrame:
    """The feature vectors of scopes whose keys are one, few or many."""
    s = S.signals(spark, d)
    item = F.when(F.col("scope") == 3, 3).otherwise(F.col("customer") % (F.col("scope") * 60 + 9))
    return observed.features(s, s.groupBy("scope", item.alias("item")).agg(F.count(F.lit(1)).alias("hits")))


@query("""WITH ps AS (SELECT l_orderkey AS pair, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS lo, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS ro, max(CASE WHEN l_linenumber = 1 THEN l_partkey % 4 END) AS lp,
        max(CASE WHEN l_linenumber = 2 THEN l_partkey % 4 END) AS rp, max(CASE WHEN l_linenumber = 1 THEN l_suppkey % 7 END)::DOUBLE AS lb, max(CASE WHEN l_linenumber = 2 THEN l_suppkey % 7 END)::DOUBLE AS rb FROM lineitem GROUP BY ALL)
    SELECT pair, CASE WHEN lo IS NULL OR ro IS NULL THEN 'invalid' WHEN abs((lo - ro) / ro) > 0.05 THEN CASE WHEN lo > ro THEN 'throughput:left' ELSE 'throughput:right' END
        WHEN rp <> 0 AND abs((lp - rp) / rp) > 0.05 THEN CASE WHEN lp < rp THEN 'latency:left' ELSE 'latency:right' END
        WHEN rb > 0 AND abs(lb - rb) / rb > 0.05 THEN CASE WHEN lb < rb THEN 'bandwidth:left' ELSE 'bandwidth:right' END ELSE 'tied' END AS verdict FROM ps""")
def trials_compared(spark: SparkSession, d: str) -> DataFrame:
    """The first two lines of each order as a pair of trials."""
    line = S.table(spark, d, "lineitem")
    of = lambda n, c, kind: F.max(F.when(F.col("l_linenumber") == n, F.expr(c).cast(kind)))
    measures = {"ops": ("l_quantity", "double"), "p95": ("l_partkey % 4", "long"), "bytes": ("l_suppkey % 7", "double")}
    pairs = line.groupBy(F.col("l_orderkey").alias("pair")).agg(*(of(n, c, k).alias(f"{side}_{name}") for name, (c, k) in measures.items() for n, side in ((1, "left"), (2, "right"))))
    return observed.compare(pairs).select("pair", "verdict")


@query(None)
def telemetry_sketch(spark: SparkSession, d: str) -> DataFrame:
    """The hot keys that a sketch of 16 entries for each scope retains, with their error bound."""
    return fold.sketch(S.telemetry(spark, d), 16)
