"""Signal families of a scope: what a window of samples says about queueing, compute, memory, debt, lag, migration and topology.

Every family is one grouped aggregation with partial sums; means and ratios are one division of exact sums, null without a denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestate.operators.telemetry import monotone

#: Bounds of the feature vector's flags.
PRESSURE_HIGH_PPM, HOTSPOT_BYTES, SMALL_BYTES, LARGE_BYTES = 750_000, 1_000_000, 1_000_000, 1_000_000
MANY_HOT_KEYS, MANY_HOT_SHARE_PPM, SINGLE_KEY_SHARE_PPM = 2, 500_000, 900_000


def _mean(c: str) -> Column:
    return F.sum(c) / F.count(F.lit(1))


def _ratio(a: str, b: str) -> Column:
    return F.try_divide(F.sum(a), F.sum(b))


def collect(samples: DataFrame, cap: int) -> DataFrame:
    """The samples that a scope of `cap` samples takes: sequences above all before them, and the first `cap` of those."""
    taken = F.row_number().over(Window.partitionBy("scope").orderBy("arrival"))
    return monotone(samples).withColumn("n", taken).where(F.col("n") <= cap).drop("n")


def request_rates(samples: DataFrame) -> DataFrame:
    """Requests, reads and writes per second of observed time, and the share of reads (null without requests)."""
    by = samples.groupBy("scope", "window").agg(F.sum("reads").alias("r"), F.sum("writes").alias("w"), (F.sum("period_us") / 1_000_000).alias("s"))
    rate = lambda c: F.try_divide(c.cast("double"), F.col("s"))
    return by.select(
        "scope", "window", rate(F.col("r") + F.col("w")).alias("requests_per_second"), rate(F.col("r")).alias("reads_per_second"),
        rate(F.col("w")).alias("writes_per_second"), F.try_divide(F.col("r"), F.col("r") + F.col("w")).alias("read_ratio"),
    )


def queueing(samples: DataFrame) -> DataFrame:
    return samples.groupBy("scope").agg(
        F.max("depth").alias("max_depth"), _mean("wait_p50").alias("mean_wait_p50"), _mean("wait_p99").alias("mean_wait_p99"),
        _mean("wait_p999").alias("mean_wait_p999"), F.sum("rejections").alias("rejections"),
    )


def compute(samples: DataFrame) -> DataFrame:
    return samples.groupBy("scope").agg(_mean("cpu_ns").alias("mean_cpu"), _mean("service_ns").alias("mean_service"), _ratio("cpu_ns", "service_ns").alias("cpu_to_service"))


def memory(samples: DataFrame) -> DataFrame:
    """The last sample's bytes and residency; no window is sorted for it."""
    last = samples.groupBy("scope").agg(F.max_by(F.struct("resident_bytes", "logical_bytes"), "sequence").alias("m")).select("scope", "m.*")
    return last.withColumn("residency_ratio", F.try_divide("resident_bytes", "logical_bytes"))


def memory_pressure(samples: DataFrame) -> DataFrame:
    """pressure_pct: percent, so that the mean is one division of integers."""
    return samples.groupBy("scope").agg(
        (F.sum("pressure_pct") / (100 * F.count(F.lit(1)))).alias("mean_pressure"), F.sum("attempts").alias("attempts"), F.sum("failures").alias("failures")
    )


def migration_cost(samples: DataFrame) -> DataFrame:
    return samples.groupBy("scope").agg(
        F.sum("moved_bytes").alias("bytes"), F.sum("moves").alias("operations"), F.sum("cpu_ns").alias("cpu_ns"), F.sum("service_ns").alias("io_ns"),
        _ratio("cpu_ns", "moved_bytes").alias("cpu_ns_per_byte"), _ratio("service_ns", "moved_bytes").alias("io_ns_per_byte"),
    )


def io_bytes(samples: DataFrame) -> DataFrame:
    return samples.groupBy("scope").agg(*(F.sum(c).alias(c) for c in ("received", "transmitted", "storage_read", "storage_written", "storage_synced")))


def consensus_lag(samples: DataFrame) -> DataFrame:
    return samples.groupBy("scope").agg(
        _mean("commit_lag").alias("mean_commit_lag"), F.max("commit_lag").alias("max_commit_lag"), _mean("replica_lag").alias("mean_replica_lag"), F.max("replica_lag").alias("max_replica_lag")
    )


def peaks(samples: DataFrame) -> DataFrame:
    """Maintenance debt, redundancy and degraded assets merge by their peaks, field by field; amplification is that of the peaks."""
    fields = ["checkpoint_bytes", "checkpoint_age", "repair_assets", "repair_bytes", "repair_age", "scrub_bytes", "scrub_age", "physical_bytes", "stored_bytes", "fragments", "degraded_assets"]
    return samples.groupBy("scope").agg(*(F.max(c).alias(c) for c in fields)).withColumn("amplification", F.try_divide("physical_bytes", "stored_bytes"))


def offcore(samples: DataFrame, cap: int) -> DataFrame:
    """Exact nearest-rank quantiles of the last `cap` off-core reads of each scope, and all promoted bytes."""
    recent = samples.withColumn("n", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("sequence")))).where(F.col("n") <= cap)
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by service_ns)").cast("long")
    quantiles = recent.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), at(0.5).alias("p50"), at(0.99).alias("p99"), at(0.999).alias("p999"), F.max("service_ns").alias("max"))
    return quantiles.join(samples.groupBy("scope").agg(F.sum("moved_bytes").alias("promoted_bytes")), "scope")


def topology(samples: DataFrame) -> DataFrame:
    """Busiest to mean load of workers and tablets, by the last sample."""
    last = samples.groupBy("scope").agg(F.max_by(F.struct("busiest_worker", "mean_worker", "busiest_tablet", "mean_tablet"), "sequence").alias("t")).select("scope", "t.*")
    return last.select("scope", F.try_divide("busiest_worker", "mean_worker").alias("worker_max_to_mean"), F.try_divide("busiest_tablet", "mean_tablet").alias("tablet_max_to_mean"))


def features(samples: DataFrame, hits: DataFrame) -> DataFrame:
    """The feature vector of each scope: parts per million (cut, not rounded) and the flags that rules look at. hits: scope, item,
    hits. A key is hot with one in a hundred hits, unless it was hit once."""
    ppm = lambda c: F.coalesce((c * 1_000_000).cast("long"), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("hits"), "item"))
    top = hits.withColumn("rank", rank).where(F.col("rank") <= 10).groupBy("scope").agg(F.max("hits").alias("top1"), F.sum("hits").alias("top10"))
    every = hits.groupBy("scope").agg(F.count(F.lit(1)).alias("keys"), F.sum("hits").alias("total"), F.max("hits").alias("most"))
    keys = every.join(top, "scope").withColumn("any_hot", (F.col("most") > 1) & (F.col("most") * 100 >= F.col("total")))
    of = memory(samples).join(memory_pressure(samples), "scope").join(io_bytes(samples), "scope").join(topology(samples), "scope").join(keys, "scope")
    io = F.col("storage_read") + F.col("storage_written")
    of = of.withColumns({"pressure_ppm": ppm(F.col("mean_pressure")), "top_key_ppm": ppm(F.col("top1") / F.col("total")), "top_ten_ppm": ppm(F.col("top10") / F.col("total"))})
    return of.select(
        "scope", "pressure_ppm", ppm(F.col("worker_max_to_mean")).alias("worker_imbalance_ppm"), ppm(F.col("tablet_max_to_mean")).alias("tablet_imbalance_ppm"), "top_key_ppm", "top_ten_ppm",
        ((F.col("keys") == 1) & (F.col("top_key_ppm") >= SINGLE_KEY_SHARE_PPM)).alias("single_hot_key"),
        ((F.col("keys") >= MANY_HOT_KEYS) & (F.col("top_ten_ppm") >= MANY_HOT_SHARE_PPM)).alias("many_key_hotspot"),
        ((F.col("resident_bytes") >= HOTSPOT_BYTES) | (F.col("pressure_ppm") >= PRESSURE_HIGH_PPM)).alias("memory_hotspot"), (io >= HOTSPOT_BYTES).alias("storage_hotspot"),
        ((F.col("logical_bytes") >= LARGE_BYTES) & ~F.col("any_hot")).alias("cold_large"), ((F.col("logical_bytes") <= SMALL_BYTES) & F.col("any_hot")).alias("hot_small"),
    )


def compare(pairs: DataFrame, margin: float = 0.05) -> DataFrame:
    """The verdict of each pair (ops, p95 and bytes per operation of left and right): throughput decides beyond the margin, then p95
    latency, then bytes; else they are tied. A side without a positive, finite throughput makes the pair invalid."""
    lo, ro, lp, rp, lb, rb = (F.col(c) for c in ("left_ops", "right_ops", "left_p95", "right_p95", "left_bytes", "right_bytes"))
    sane = lambda c: c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))
    gain, slower = (lo - ro) / ro, F.when(rp == 0, 0.0).otherwise((lp - rp) / rp)
    heavier = F.coalesce(F.when(rb > 0, F.abs(lb - rb) / rb > margin), F.lit(False))
    side = lambda name, left: F.when(left, f"{name}:left").otherwise(f"{name}:right")
    verdict = (
        F.when(~(sane(lo) & sane(ro)), "invalid").when(F.abs(gain) > margin, side("throughput", gain > 0))
        .when(F.abs(slower) > margin, side("latency", lp < rp)).when(heavier, side("bandwidth", lb < rb)).otherwise("tied")
    )
    return pairs.withColumn("verdict", verdict)
