"""Windowed telemetry by scope: rates, exact quantiles, hot keys, concentration, criticality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LATENCY_CAP = 256


def monotone(samples: DataFrame) -> DataFrame:
    """Samples whose sequence rises above all before it (by arrival) in their scope; the others are rejected."""
    w = Window.partitionBy("scope").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return samples.withColumn("before", F.max("sequence").over(w)).where("before is null or sequence > before").drop("before")


def rates(samples: DataFrame) -> DataFrame:
    """Reads and writes by scope and window, share of reads (null without requests)."""
    return samples.groupBy("scope", "window").agg(F.sum("reads").alias("reads"), F.sum("writes").alias("writes")).withColumn("read_ratio", F.try_divide("reads", F.col("reads") + F.col("writes")))


def latency_quantiles(samples: DataFrame, cap: int = LATENCY_CAP) -> DataFrame:
    """Exact nearest-rank quantiles of the last `cap` samples of each scope."""
    recent = samples.withColumn("n", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("sequence")))).where(F.col("n") <= cap)
    ranked = recent.withColumns({"rank": F.row_number().over(Window.partitionBy("scope").orderBy("latency_ns")), "all": F.count(F.lit(1)).over(Window.partitionBy("scope"))})
    at = lambda permille: F.max(F.when(F.col("rank") == F.expr(f"({permille} * `all` + 999) div 1000"), F.col("latency_ns")))
    return ranked.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), at(500).alias("p50"), at(990).alias("p99"), at(999).alias("p999"), F.max("latency_ns").alias("max"))


def hot_keys(samples: DataFrame, top: int = 10) -> DataFrame:
    """Exact heavy hitters of each scope, with their hotness and execution class. Counts are pre-aggregated by (scope, item)."""
    counts = samples.groupBy("scope", "item").agg(F.count(F.lit(1)).alias("hits"), F.sum(F.col("critical").cast("long")).alias("critical"), F.sum(F.col("tail").cast("long")).alias("tails"))
    totals = samples.groupBy("scope").agg(F.count(F.lit(1)).alias("total"))
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("hits"), "item"))
    rows = counts.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "scope")
    hotness = F.when(F.col("hits") == 1, "Cold").when(F.col("hits") * 100 >= F.col("total"), "Hot").otherwise("Warm")
    kind = F.when(2 * F.col("critical") >= F.col("hits"), "CriticalPath").when(2 * F.col("tails") >= F.col("hits"), "TailSensitive").otherwise("Ordinary")
    return rows.select("scope", F.col("rank").cast("long").alias("rank"), "item", "hits", hotness.alias("hotness"), kind.alias("class"))


def concentration(samples: DataFrame) -> DataFrame:
    """Top-1 and top-10 hits and the sum of squared hits of each scope, with the Herfindahl index as one division. Only the first ten
    keys of a scope are ranked; the sums are partial ones."""
    counts = samples.groupBy("scope", "item").agg(F.count(F.lit(1)).alias("hits"))
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("hits"), "item"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= 10).groupBy("scope").agg(F.sum("hits").alias("top10"))
    sums = counts.groupBy("scope").agg(F.max("hits").alias("top1"), F.sum("hits").alias("total"), F.sum(F.col("hits") * F.col("hits")).alias("squares"))
    return sums.join(top, "scope").select("scope", "top1", "top10", "total", "squares", (F.col("squares") / (F.col("total") * F.col("total"))).alias("herfindahl"))


def criticality(serial: Column, latency: Column, stall: Column, critical_ppm: Column, tail_ppm: Column, size: Column) -> Column:
    """(serial * latency + stall) * (100000 + critical/2 + tail/2) / 1e6 / max(size, 1), each division rounding down."""
    weight = F.lit(100_000) + F.floor(critical_ppm / 2) + F.floor(tail_ppm / 2)
    work = (serial * latency + stall).cast("decimal(38,0)") * weight.cast("decimal(12,0)")
    return F.floor(F.floor(work / 1_000_000) / F.greatest(size, F.lit(1))).cast("long")


def weighted(samples: DataFrame) -> DataFrame:
    """Access-weighted mean stall (rounded down) and its peak by scope."""
    by = samples.groupBy("scope", "item").agg(F.max("stall").alias("score"), F.count(F.lit(1)).alias("accesses"))
    return by.groupBy("scope").agg(F.sum(F.col("score") * F.col("accesses")).alias("s"), F.sum("accesses").alias("accesses"), F.max("score").alias("peak")).select("scope", F.expr("s div accesses").alias("mean_score"), "peak")


def sustained(flags: DataFrame, least: int = 3) -> DataFrame:
    """scope, window, run: how many windows in a row the flag has held, and whether that is sustained."""
    w = Window.partitionBy("scope").orderBy("window")
    islands = flags.withColumn("island", F.sum((~F.col("flag")).cast("long")).over(w))
    run = F.sum(F.col("flag").cast("long")).over(Window.partitionBy("scope", "island").orderBy("window"))
    return islands.withColumn("run", run).select("scope", "window", "run", (F.col("run") >= least).alias("sustained"))


def latest(samples: DataFrame) -> DataFrame:
    """The last sample of each scope and window."""
    return samples.groupBy("scope", "window").agg(F.max_by(F.struct("sequence", "item", "stall"), "sequence").alias("s")).select("scope", "window", "s.*")


def savings(sizes: DataFrame) -> DataFrame:
    """Compression ratio and savings (negative where data grew) by group."""
    by = sizes.groupBy("group").agg(F.sum("raw").alias("raw"), F.sum("packed").alias("packed"))
    return by.select("group", F.try_divide("packed", "raw").alias("ratio"), F.try_divide(F.col("raw") - F.col("packed"), "raw").alias("savings"))


def extremes(samples: DataFrame) -> DataFrame:
    """Hardware counters by scope: worst values, not means; counts add up even where nothing was measured."""
    return samples.groupBy("scope").agg(F.min("trust").alias("trust"), F.max("stall").alias("stall"), F.max("ipc").alias("ipc"), F.sum("misses").alias("misses"))


def bound_by(stall: Column, miss: Column, ipc: Column) -> Column:
    """Memory: stall above 0.35 with misses above 0.2; Cpu: 1.5 instructions a cycle or more with stall below 0.15."""
    return F.when((stall > 0.35) & (miss > 0.2), "Memory").when((ipc >= 1.5) & (stall < 0.15), "Cpu").otherwise("Neither")


def evidence(samples: DataFrame) -> DataFrame:
    """Oldest and newest sample, least confidence and the union of the source bits of each scope."""
    return samples.groupBy("scope").agg(F.min("sequence").alias("oldest"), F.max("sequence").alias("newest"), F.min("confidence").alias("confidence"), F.bit_or("sources").alias("sources"))


def access_rollup(signals: DataFrame) -> DataFrame:
    """Access signals (scope, accesses, cpu_ns, bytes) as one criticality signal for each scope; an idle object counts 1 ns."""
    return signals.groupBy("scope").agg(
        F.sum("accesses").alias("accesses"),
        F.sum(F.expr("accesses div 2")).alias("critical"),
        F.sum("cpu_ns").alias("stall_ns"),
        F.max(F.when(F.col("accesses") == 0, 1).otherwise(F.expr("cpu_ns div nullif(accesses, 0)"))).cast("long").alias("latency_ns"),
        (F.sum("bytes") + 1).alias("bytes"),
    )


def trials(reports: DataFrame) -> DataFrame:
    """Median, least, greatest and spread of repeated trials; valid only if every trial is."""
    by = reports.groupBy("name").agg(
        F.expr("percentile(throughput, 0.5)").alias("throughput"), F.min("throughput").alias("least"), F.max("throughput").alias("most"),
        F.expr("percentile(latency, 0.5)").alias("latency"), (F.max("latency") - F.min("latency")).alias("latency_spread"), F.bool_and("valid").alias("valid"),
    )
    return by.withColumn("spread", F.try_divide(F.col("most") - F.col("least"), "throughput"))


def hysteresis(values: DataFrame, enter: int, release: int) -> DataFrame:
    """scope, window, run: windows in a row since `value` reached `enter` and has not fallen below `release`. Only a value at
    or above `enter` or below `release` changes the state, so the state is the last such value's: no fold is needed."""
    w = Window.partitionBy("scope").orderBy("window")
    turn = F.when(F.col("value") >= enter, True).when(F.col("value") < release, False)
    flags = values.withColumn("flag", F.coalesce(F.last(turn, True).over(w), F.lit(False)))
    return sustained(flags.select("scope", "window", "flag")).select("scope", "window", "run")
