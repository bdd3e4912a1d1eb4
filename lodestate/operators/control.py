"""Decisions over telemetry and topology: health, placement, budgets, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestate.operators.fold import ordered_fold

SPLIT_OBJECTS, MERGE_OBJECTS = 200_000, 20_000


def health(tablets: DataFrame, factor: int) -> DataFrame:
    """tablets: tablet, desired (voters), usable (those that serve), live_plan. A live plan goes before what it mends."""
    short = (F.col("usable") < F.least(F.lit(factor), F.greatest("desired", F.lit(1)))) | (F.col("usable") < F.col("desired"))
    state = F.when(F.col("live_plan"), "Converging").when(F.col("usable") == 0, "Unavailable").when(short, "UnderReplicated").when(F.col("usable") > factor, "OverReplicated").otherwise("Healthy")
    return tablets.select("tablet", state.alias("health"))


def triggers(tablets: DataFrame, split_objects: int, split_bytes: int, merge_objects: int, merge_right: int | None = None) -> DataFrame:
    """What to do with each tablet (tablet, ordered, objects, bytes): ordered ones split by their bytes, hash ones by their objects;
    two neighbours that both hold few objects merge. The neighbour is found by a join on the number before it, not by one sort of all."""
    right = tablets.select((F.col("tablet") - 1).alias("tablet"), F.col("objects").alias("next_objects"))
    full = F.when(F.col("ordered"), F.col("bytes") >= split_bytes).otherwise(F.col("objects") >= split_objects)
    small = (F.col("objects") <= merge_objects) & (F.col("next_objects") <= (merge_objects if merge_right is None else merge_right))
    return tablets.join(right, "tablet", "left").select("tablet", F.when(full, "Split").when(small, "Merge").otherwise("Keep").alias("action"))


def split_or_merge(tablets: DataFrame, split_at: int = SPLIT_OBJECTS, merge_at: int = MERGE_OBJECTS) -> DataFrame:
    """Split a tablet from split_at objects on; merge it with its right neighbour when both hold merge_at at most."""
    right = F.lead("objects").over(Window.orderBy("start_key"))
    action = F.when(F.col("objects") >= split_at, "Split").when((F.col("objects") <= merge_at) & (right <= merge_at), "Merge").otherwise("Keep")
    return tablets.select("tablet", action.alias("action"))

# Weights of the repair priority.
UNRECOVERABLE, NO_TOLERANCE, SCHEME_VIOLATION = 1_000_000_000_000, 800_000_000_000, 600_000_000_000
REPAIR_WEIGHTS = {
    "fragment_deficit": 1_000_000_000,
    "tolerance_deficit": 500_000_000,
    "unavailable_nodes": 10_000_000,
    "draining_nodes": 2_000_000,
    "corrupt_fragments": 20_000_000,
    "unavailable_fragments": 5_000_000,
    "concentration_excess": 1_000_000,
    "placement_violations": 2_000_000,
    "layout_drift": 250_000,
    "degraded_ms": 10_000,
    "unverified_ms": 2_000,
}
AGE_CAP_MS = 86_400_000
MIB = 1 << 20


def repair_priority(assets: DataFrame) -> DataFrame:
    """Each asset with `priority`: the gravest of three risks, weighted deficits, ages up to one day, and byte tiers. Columns
    of REPAIR_WEIGHTS, and recoverable, tolerance (what is left), meets_scheme, asset_bytes, rebuild_bytes."""
    risk = F.when(~F.col("recoverable"), UNRECOVERABLE).when(F.col("tolerance") == 0, NO_TOLERANCE).when(~F.col("meets_scheme"), SCHEME_VIOLATION).otherwise(0)
    score = risk.cast("long")
    for name, weight in REPAIR_WEIGHTS.items():
        amount = F.least(F.col(name), F.lit(AGE_CAP_MS)) if name.endswith("_ms") else F.col(name)
        score += amount * weight
    for name in ("asset_bytes", "rebuild_bytes"):
        b = F.col(name)
        score += F.when(b == 0, 0).when(b <= MIB, 1_000).when(b <= 64 * MIB, 4_000).when(b <= 1024 * MIB, 8_000).otherwise(16_000)
    return assets.withColumn("priority", score)


def debt(assets: DataFrame) -> DataFrame:
    """Degraded assets, their bytes and the highest priority of each domain."""
    return assets.where("priority > 0").groupBy("domain").agg(F.count(F.lit(1)).alias("assets"), F.sum("rebuild_bytes").alias("bytes"), F.max("priority").alias("priority"))


class Detector:
    """Liveness of one node by polls: suspect after SUSPECT misses in a row, unavailable after GRACE more; a node that came
    back from unavailable is not suspected again within COOLDOWN polls."""

    SUSPECT, GRACE, COOLDOWN = 4, 10, 120

    def __init__(self):
        self.state, self.misses, self.since_return = "Active", 0, None

    def apply(self, alive: bool) -> tuple[str, int]:
        """state and misses after the poll."""
        if alive:
            self.misses = 0
            if self.state == "Unavailable":
                self.since_return = 0
            elif self.state == "Active" and self.since_return is not None:
                self.since_return += 1
            self.state = "Active"
            return self.state, self.misses
        self.misses += 1
        if self.since_return is not None:
            self.since_return += 1
        settling = self.state == "Active" and self.since_return is not None and self.since_return < self.COOLDOWN
        if self.state == "Active" and self.misses >= self.SUSPECT and not settling:
            self.state = "Suspect"
        elif self.state == "Suspect" and self.misses >= self.SUSPECT + self.GRACE:
            self.state = "Unavailable"
        return self.state, self.misses


def liveness(polls: DataFrame) -> DataFrame:
    """key, seq, state, misses after every poll (key, seq, alive)."""
    return ordered_fold(polls, Detector, ["alive"], "state string, misses long")


def scrub_batches(targets: DataFrame, max_bytes: int) -> DataFrame:
    """lane, batch, asset, offset, bytes: what each batch of a lane checks, assets (lane, asset, bytes) in order of their number. An asset
    that does not fit is cut where the batch is full and goes on in the next one. Empty assets are passed over."""
    end = F.sum("bytes").over(Window.partitionBy("lane").orderBy("asset"))
    rows = targets.where("bytes > 0").withColumn("end", end).withColumn("start", F.col("end") - F.col("bytes"))
    rows = rows.withColumn("batch", F.explode(F.expr(f"sequence(start div {max_bytes}, (end - 1) div {max_bytes})")))
    first, last = F.greatest("start", F.col("batch") * max_bytes), F.least("end", (F.col("batch") + 1) * max_bytes)
    return rows.select("lane", "batch", "asset", (first - F.col("start")).alias("offset"), (last - first).alias("bytes"))


def redundancy(fragments: DataFrame, needed: int) -> DataFrame:
    """asset, total, usable, survivable, health of assets' fragments (asset, domain, usable): only usable fragments in different domains
    count as protection, beyond the needed ones."""
    by = fragments.groupBy("asset").agg(F.count(F.lit(1)).alias("total"), F.count_if("usable").alias("usable"), F.count_distinct(F.when(F.col("usable"), F.col("domain"))).alias("domains"))
    tolerance = F.greatest(F.col("total") - needed, F.lit(0))
    by = by.withColumn("survivable", F.least(F.greatest(F.col("domains") - needed, F.lit(0)), tolerance))
    hurt = (tolerance > F.col("survivable")) | (F.col("usable") < F.col("total"))
    health = F.when(F.col("usable") < needed, "Unrecoverable").when(hurt & (F.col("survivable") == 0), "Critical").when(hurt, "Degraded").otherwise("Healthy")
    return by.select("asset", "total", "usable", "survivable", health.alias("health"))


def spread(assets: DataFrame, nodes: DataFrame, fragments: int) -> DataFrame:
    """asset, fragment, node: each fragment goes to the node of the highest hash of (asset, fragment, node) whose domain has none of the
    asset's yet; when all domains have one, to the node with the fewest, of those the highest hash. nodes is small, which is checked."""
    found = [(r["node"], r["domain"]) for r in nodes.orderBy("node").limit(10_001).collect()]
    if not 0 < len(found) <= 10_000:
        raise ValueError("placement needs 1 to 10,000 nodes")

    def run(batches):
        import hashlib

        import pyarrow as pa

        def rank(asset, fragment, node):
            return hashlib.blake2b(f"{asset}:{fragment}:{node}".encode(), digest_size=8).digest()

        for b in batches:
            rows = []
            for asset in b["asset"].to_pylist():
                used, load = set(), dict.fromkeys((n for n, _ in found), 0)
                for fragment in range(fragments):
                    order = sorted(found, key=lambda n: (rank(asset, fragment, n[0]), n[0]), reverse=True)  # noqa: B023
                    node, domain = next((n for n in order if n[1] not in used), None) or min(order, key=lambda n: load[n[0]])  # noqa: B023
                    used.add(domain)
                    load[node] += 1
                    rows.append((asset, fragment, node))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["asset", "fragment", "node"])

    return assets.select(F.col("asset").cast("long")).mapInArrow(run, "asset long, fragment long, node long")
