"""Workloads: deterministic mixes of operations over a keyspace, and payloads of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Each mix as its cycle of operations, in runs.
MIXES = {
    "get": [("get", 1)],
    "set": [("set", 1)],
    "counter": [("counter_add", 1)],
    "mixed": [("get", 1), ("set", 1), ("counter_add", 1), ("delete", 1)],
    "cache": [("get", 12), ("exists", 4), ("get_range", 3), ("ttl", 1)],
    "read_heavy": [("get", 14), ("exists", 3), ("get_range", 2), ("set", 1)],
    "balanced": [("get", 4), ("set", 4), ("delete", 3), ("exists", 3), ("get_range", 2), ("set_range", 1), ("expire", 1), ("ttl", 2)],
    "delete": [("delete", 1)],
    "exists": [("exists", 1)],
    "compat": [("get", 1), ("set", 1), ("expire", 1), ("ttl", 1), ("set_range", 1)],
    "range": [("get_range", 1)],
}
PAYLOAD_SEED = 0xBE4C4


def operations(spark: SparkSession, mix: str, count: int, keys: int | None, threads: int | None = None) -> DataFrame:
    """i, thread, op, key of `count` operations (of each thread): keys None is one hot key; with threads, each has `keys` keys of its own,
    else all share them. Counters have a key of their own."""
    cycle = [op for op, times in MIXES[mix] for _ in range(times)]
    i = spark.range(count).withColumnRenamed("id", "i")
    rows = i.withColumn("thread", F.explode(F.sequence(F.lit(0), F.lit((threads or 1) - 1))))
    owner = F.lit("hot") if keys is None else F.concat(F.lit("t"), F.col("thread").cast("string")) if threads else F.lit("g")
    plain = owner if keys is None else F.concat(owner, F.lit("k" if threads else ""), (F.col("i") % keys).cast("string"))
    op = F.element_at(F.array(*map(F.lit, cycle)), (F.col("i") % len(cycle) + 1).cast("int"))
    rows = rows.withColumn("op", op)
    return rows.withColumn("key", F.when(F.col("op") == "counter_add", F.concat(owner, F.lit(":c"))).otherwise(plain))


def payload(size: int, seed: int = PAYLOAD_SEED) -> bytes:
    """`size` bytes of the public splitmix64 generator: incompressible, and the same everywhere."""
    import numpy as np

    step = np.arange(1, -(-size // 8) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    z = (step ^ (step >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype("<u8").tobytes()[:size]


def payload_column(size: int, seed: int = PAYLOAD_SEED) -> Column:
    return F.lit(payload(size, seed))
