"""Tablet directories: hash tilings and ordered ranges, cutovers of splits and merges, redirects, checks of a snapshot.

A hash tile is a string of leading bits of a key's 128-bit route hash (MD5 of namespace and key). An ordered directory is a table of
tablets: tablet, start_key, end_key (null: unbounded), state (Inactive, Active, Fenced, Tombstone), redirect (array of tablets).
Directories are tables like any other: checks are windows and joins, never loops over tablets on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestate.functions.dialect import bits_of_hex


def static_tiles(spark: SparkSession, count: int) -> DataFrame:
    """tablet, bits: `count` tiles of the hash space. The largest tile (of equal ones the oldest) is halved until there are enough; a
    retired parent keeps its number, so tiles have the numbers that halving gave them."""
    if count < 1:
        raise ValueError("a directory needs a tablet")
    tiles, last = [(1, "")], 1
    while len(tiles) < count:
        at = min(range(len(tiles)), key=lambda i: len(tiles[i][1]))
        _, bits = tiles.pop(at)
        tiles += [(last + 1, bits + "0"), (last + 2, bits + "1")]
        last += 2
    return spark.createDataFrame(tiles, "tablet long, bits string")


def route_hash(namespace: int, key: Column) -> Column:
    """128 bits as lower-case hex."""
    return F.md5(F.concat(F.lit(f"{namespace}:"), key).cast("binary"))


def route_hashed(keys: DataFrame, tiles: DataFrame, namespace: int) -> DataFrame:
    """keys with hash and tablet. Tiles are spread over the slots of the longest prefix, so that routing is an equi-join."""
    depth = tiles.agg(F.max(F.length("bits"))).first()[0]
    slots = tiles.select("tablet", F.explode(F.expr(f"sequence(0L, shiftleft(1L, {depth} - length(bits)) - 1)")).alias("rest"), "bits")
    rest = F.lpad(F.conv(F.col("rest").cast("string"), 10, 2), depth, "0")
    slots = slots.select("tablet", F.substring(F.concat("bits", F.substring(rest, F.length("bits") + 1, F.lit(depth))), 1, max(depth, 1)).alias("slot"))
    hashed = keys.withColumn("hash", route_hash(namespace, F.col("key")))
    return hashed.withColumn("slot", F.substring(bits_of_hex(F.substring("hash", 1, 16)), 1, depth) if depth else F.lit("")).join(slots, "slot").drop("slot")


def hash_overlaps(a: Column, b: Column) -> Column:
    """Whether two tiles share a hash: one is a prefix of the other."""
    return a.startswith(b) | b.startswith(a)


def contains(start: Column, end: Column, key: Column) -> Column:
    return (key >= start) & (end.isNull() | (key < end))


def split_at(ranges: DataFrame, key: Column) -> DataFrame:
    """Each range with the halves that `key` makes of it; null and status InvalidSplitKey where it is not strictly inside."""
    inside = (key > F.col("start_key")) & (F.col("end_key").isNull() | (key < F.col("end_key")))
    return ranges.select("tablet", F.when(inside, "Ok").otherwise("InvalidSplitKey").alias("status"), F.when(inside, key).alias("split_key"))


def merge_pairs(ranges: DataFrame) -> DataFrame:
    """Each range with its right neighbour where they are adjacent: tablet, other, start_key, end_key of the merged range."""
    right = ranges.select(F.col("tablet").alias("other"), F.col("start_key").alias("end_here"), F.col("end_key").alias("merged_end"))
    return ranges.join(right, F.col("end_key") == F.col("end_here")).select("tablet", "other", "start_key", F.col("merged_end").alias("end_key"))


def cutover(directory: DataFrame, plans: DataFrame) -> DataFrame:
    """The directory after plans (parents, children: arrays of tablets) are published: fenced parents become tombstones that redirect
    to the children, inactive children become active. A plan is published whole or, where a state does not fit, not at all."""
    named = plans.withColumn("plan", F.monotonically_increasing_id())
    sides = named.select("plan", F.explode("parents").alias("tablet"), F.lit("Fenced").alias("needs"), F.lit("Tombstone").alias("becomes"), F.col("children").alias("to")).unionByName(
        named.select("plan", F.explode("children").alias("tablet"), F.lit("Inactive").alias("needs"), F.lit("Active").alias("becomes"), F.lit(None).cast("array<bigint>").alias("to"))
    )
    seen = sides.join(directory.select("tablet", "state"), "tablet", "left")
    legal = seen.groupBy("plan").agg(F.bool_and(F.col("state").eqNullSafe(F.col("needs"))).alias("legal")).where("legal")
    changes = seen.join(legal, "plan", "left_semi").select("tablet", "becomes", "to")
    after = directory.join(changes, "tablet", "left")
    return after.select("tablet", "start_key", "end_key", F.coalesce("becomes", "state").alias("state"), F.when(F.col("becomes").isNotNull(), F.col("to")).otherwise(F.col("redirect")).alias("redirect"))


def violations(directory: DataFrame) -> DataFrame:
    """tablet, problem: what keeps a snapshot from being valid."""
    twice = directory.groupBy("tablet").count().where("count > 1").select("tablet", F.lit("DuplicateTabletId").alias("problem"))
    tomb = F.col("state") == "Tombstone"
    redirect = F.when(tomb & F.col("redirect").isNull(), "RedirectMissing").when(~tomb & F.col("redirect").isNotNull(), "UnexpectedRedirect")
    wrong = directory.select("tablet", redirect.alias("problem")).where("problem is not null")
    over = overlapping(directory.where("state = 'Active'")).select("tablet", F.lit("OverlappingActiveAuthority").alias("problem"))
    return twice.unionByName(wrong).unionByName(over)


def overlapping(ranges: DataFrame) -> DataFrame:
    """Ranges that begin before one that starts earlier has ended. The running maximum is taken in runs of starts with the same first
    characters, and what earlier runs reach is added: no task sorts all ranges."""
    run = F.substring("start_key", 1, 8)
    reach = F.coalesce("end_key", F.lit("\U0010ffff"))
    runs = ranges.groupBy(run.alias("run")).agg(F.max(reach).alias("furthest"))
    before = runs.withColumn("earlier", F.max("furthest").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy("run").orderBy("start_key", "tablet").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges.withColumn("run", run).join(before.select("run", "earlier"), "run").withColumn("reach", F.greatest(F.max(reach).over(w), F.col("earlier")))
    return rows.where("reach > start_key").select("tablet", "start_key")


def coverage_complete(directory: DataFrame) -> DataFrame:
    """One row: whether the active ranges tile all keys: one starts at the empty key, one is unbounded, every other end is a start and
    nothing overlaps."""
    active = directory.where("state = 'Active'")
    starts = active.select(F.col("start_key").alias("end_key"), F.lit(True).alias("met"))
    met = active.join(starts, "end_key", "left")
    whole = met.agg(
        (F.count_if(F.col("start_key") == "") == 1).alias("a"), (F.count_if(F.col("end_key").isNull()) == 1).alias("b"),
        (F.count_if(F.col("end_key").isNotNull() & F.col("met").isNull()) == 0).alias("c"),
    )
    over = overlapping(active).agg((F.count(F.lit(1)) == 0).alias("d"))
    return whole.join(F.broadcast(over)).select((F.col("a") & F.col("b") & F.col("c") & F.col("d")).alias("complete"))  # one row and one row


def successors(directory: DataFrame) -> DataFrame:
    """(tablet, successor): the active tablets that each tombstone's redirects lead to, through tombstones on the way. Redirect chains
    are followed step by step until none is left, each step a join."""
    redirects = directory.where("state = 'Tombstone'").select("tablet", F.explode("redirect").alias("next"))
    active = directory.where("state = 'Active'").select(F.col("tablet").alias("next"))
    found, at = redirects.join(active, "next", "left_semi"), redirects
    hops = redirects.select(F.col("tablet").alias("next"), F.col("next").alias("then"))
    while True:
        at = at.join(hops, "next").select("tablet", F.col("then").alias("next")).distinct()
        if at.isEmpty():
            return found.distinct().select("tablet", F.col("next").alias("successor"))
        found = found.unionByName(at.join(active, "next", "left_semi"))


def route_retired(keys: DataFrame, directory: DataFrame) -> DataFrame:
    """keys (key, tablet) that know a retired tablet, with the live successor whose range holds the key."""
    live = successors(directory).join(directory.select(F.col("tablet").alias("successor"), "start_key", "end_key"), "successor")
    return keys.join(live, "tablet").where(contains(F.col("start_key"), F.col("end_key"), F.col("key"))).select("key", "tablet", "successor")
