"""Read contracts: which applied position a read may use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded_stale(reads: DataFrame, receipts: DataFrame) -> DataFrame:
    """Each read (lane, id, now_us, max_age_us, authority, incarnation, applied) against its lane's newest receipt (proven_us, position,
    authority, incarnation) so far: it serves the read if it comes from the same authority and incarnation, lies at or before what is
    applied, and is young enough. An as-of join by one union and one running window, dealt by lane."""
    proof = F.struct("proven_us", "position", "authority", "incarnation")
    sides = receipts.select("lane", F.col("proven_us").alias("at"), F.lit(0).alias("side"), proof.alias("receipt"))
    sides = reads.withColumnRenamed("now_us", "at").withColumn("side", F.lit(1)).unionByName(sides, allowMissingColumns=True)
    w = Window.partitionBy("lane").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = sides.withColumn("r", F.last("receipt", True).over(w)).where("side = 1")
    young = F.col("at") - F.col("r.proven_us") <= F.col("max_age_us")
    same = (F.col("authority") == F.col("r.authority")) & (F.col("incarnation") == F.col("r.incarnation")) & (F.col("r.position") <= F.col("applied"))
    ok = F.coalesce(young & same, F.lit(False))
    return found.select("id", F.when(ok, "Ok").otherwise("Escalate").alias("status"), F.when(ok, F.col("r.position")).alias("position"))


def any_state(reads: DataFrame, applied: DataFrame) -> DataFrame:
    """Reads without a claim (id, lane, cached: the position of a cached answer or null): the cache where it is as far as what is
    applied, else the local state, at the position it has."""
    seen = reads.join(applied.select("lane", "applied"), "lane", "left")
    path = F.when(F.col("applied").isNull(), "Unavailable").when(F.col("cached") == F.col("applied"), "Cache").otherwise("Local")
    return seen.select("id", path.alias("path"), F.col("applied").alias("position"))


def at_least(reads: DataFrame, applied: DataFrame) -> DataFrame:
    """A read with a token needs its lane's epoch to be the token's, and a position applied at least as far."""
    seen = reads.join(applied.select("lane", "applied", F.col("epoch").alias("now_epoch")), "lane", "left")
    stale = F.col("now_epoch").isNotNull() & (F.col("epoch") != F.col("now_epoch"))
    return seen.select("id", F.when(stale, "StaleToken").when(F.col("applied") >= F.col("token"), "Ok").otherwise("Unavailable").alias("status"))
