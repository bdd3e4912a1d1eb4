"""Plans over a topology: phases, placement of objects on providers, replica moves, an action ledger, the controller's rules.

Moves are greedy by definition: each choice sees the load that earlier ones made. A cluster's tablets are planned by one task, in
order, and clusters run side by side; what a task holds is the cluster's nodes, never data.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestate.operators.fold import ordered_fold

# Which phases each phase of a plan may go on to, besides staying and Failed (from all but the last).
SPLIT = ["Planned", "ChildrenProvisioning", "BaseSeeded", "Fenced", "ChildrenReady", "CutoverCommitted", "ParentRetiring", "Completed"]
MERGE = ["Planned", "TargetAllocated", "BaseSeeded", "Fenced", "TargetReady", "CutoverCommitted", "ParentsRetiring", "Completed"]
MIGRATION = ["Planned", "TargetStarting", "LearnerAdded", "Ready", "MembershipChanging", "Committed", "SourceRetiring", "Completed"]
BACKWARDS = {("Fenced", "BaseSeeded")}  # of splits and merges: a fence lifted before any routing moved


class Phases:
    """The lifecycle of one plan: each step goes one phase on, or to Failed; others are refused and change nothing."""

    def __init__(self):
        self.phase = "Planned"

    def apply(self, kind: str, wanted: str) -> tuple[str, str]:
        """status, phase after."""
        steps = {"split": SPLIT, "merge": MERGE, "migration": MIGRATION}[kind]
        legal = {*zip(steps, steps[1:], strict=False), *((s, "Failed") for s in steps[:-1])}
        if kind != "migration":
            legal |= BACKWARDS
        if wanted != self.phase and (self.phase, wanted) not in legal:
            return "IllegalTransition", self.phase
        self.phase = wanted
        return "Ok", self.phase


def phases(log: DataFrame) -> DataFrame:
    """key, seq, status, phase of every step (kind, wanted) of every plan."""
    return ordered_fold(log, Phases, ["kind", "wanted"], "status string, phase string")


class Budget:
    """What one tick of moves may use. A move that does not fit is refused and uses nothing."""

    BYTES, OPS, CPU_NS = 5_000_000, 40, 4_000_000

    def __init__(self):
        self.bytes = self.ops = self.cpu = 0

    def apply(self, size: int, cpu: int) -> tuple[bool, int, int]:
        """admitted, bytes and operations used after."""
        fits = self.bytes + size <= self.BYTES and self.ops + 1 <= self.OPS and self.cpu + cpu <= self.CPU_NS
        if fits:
            self.bytes, self.ops, self.cpu = self.bytes + size, self.ops + 1, self.cpu + cpu
        return fits, self.bytes, self.ops


def budget(moves: DataFrame) -> DataFrame:
    """lane, id, admitted, used_bytes, used_ops of moves (lane, id, priority, bytes, cpu_ns), highest priority first."""
    place = F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("priority"), "id")).cast("long")
    log = moves.withColumns({"key": F.col("lane"), "seq": place})
    done = ordered_fold(log, Budget, ["bytes", "cpu_ns"], "admitted boolean, used_bytes long, used_ops long")
    return log.select("key", "seq", "lane", "id").join(done, ["key", "seq"]).select("lane", "id", "admitted", "used_bytes", "used_ops")


class Ledger:
    """Admission of actions of one controller: an action whose key was admitted within `COOLDOWN` windows is a duplicate, one whose
    conflict key was is a conflict, and a window admits `PER_WINDOW` at most."""

    COOLDOWN, PER_WINDOW = 2, 8

    def __init__(self):
        self.keys, self.conflicts, self.window, self.admitted = {}, {}, None, 0

    def apply(self, action: str, conflict: str, window: int) -> tuple[str, int]:
        """status, admitted in this window so far."""
        if window != self.window:
            self.window, self.admitted = window, 0
        recent = lambda at: at is not None and window - at <= self.COOLDOWN
        if recent(self.keys.get(action)):
            return "Duplicate", self.admitted
        if recent(self.conflicts.get(conflict)):
            return "Conflict", self.admitted
        if self.admitted >= self.PER_WINDOW:
            return "RateLimit", self.admitted
        self.keys[action] = self.conflicts[conflict] = window
        self.admitted += 1
        return "Ok", self.admitted


def ledger(actions: DataFrame) -> DataFrame:
    return ordered_fold(actions, Ledger, ["action", "conflict", "window"], "status string, admitted long")


#: The controller's rules: the first whose flag (or flags) is sustained decides.
RULES = [
    (("memory_high",), "AdjustMemoryBudget-"),
    (("memory_low", "criticality"), "Materialize"),
    (("memory_bound",), "AdjustScrubBudget-"),
    (("migrated",), "AdjustScrubBudget-"),
    (("latency_bad",), "AdjustScrubBudget-"),
    (("repair_debt",), "AdjustRepairBudget+"),
    (("imbalance",), "RecommendMigration"),
    (("many_hotspot",), "RecommendTabletSplit"),
    (("cold_large",), "ErasureCoding(4,2)"),
    (("hot_small",), "Replication(3)"),
]


def controller(flags: DataFrame, least: int = 3) -> DataFrame:
    """scope, window, action (null: none) of flags by scope and window: a flag counts once it has held `least` windows in a row. All
    runs share one sort; budgets carried between windows are not part of it."""
    names = sorted({f for needs, _ in RULES for f in needs})
    w = Window.partitionBy("scope").orderBy("window")
    numbered = flags.withColumn("n", F.row_number().over(w))
    broken = lambda name: F.coalesce(F.max(F.when(~F.col(name), F.col("n"))).over(w), F.lit(0))
    held = numbered.withColumns({f"{name}_run": F.col("n") - broken(name) for name in names})
    action = F.lit(None).cast("string")
    for needs, does in reversed(RULES):
        rule = functools.reduce(Column.__and__, (F.col(f"{name}_run") >= least for name in needs))
        action = F.when(rule, does).otherwise(action)
    return held.select("scope", "window", action.alias("action"))


def placement_cost(latency: Column, pressure: Column, score: Column, size: Column, cost: Column, weight: Column, move: Column, here: Column, remote: Column, horizon: int = 10_000) -> Column:
    """What serving an object from a provider costs: access (its latency under load, weighted by the object's score), storage, the move
    spread over the horizon, less the relief of staying off a pressed provider, plus the hop to another node."""
    loaded = 1 + pressure * 2
    access = F.greatest(latency, F.lit(1.0)) * loaded * (1 + F.log1p(score + 1))
    return access + size * cost * (weight / 100) * 1e-6 + move / horizon - F.when(here, pressure * 1e6).otherwise(0.0) + remote * loaded


def place(objects: DataFrame, providers: DataFrame, least_gain: float = 0.1, cooldown: int = 500) -> DataFrame:
    """object, provider, reason: the cheapest provider of each object (of equal ones the smallest), which stays where it is within the
    cooldown, and for a gain below `least_gain`. providers is a list of devices: its size is checked, and it travels as one row."""
    if providers.count() > 10_000:
        raise ValueError("a registry has 10,000 providers at most")
    devices = providers.agg(F.collect_list(F.struct("provider", "latency", "byte_cost", "node", "hop")).alias("devices"))

    def priced(d):
        cost = placement_cost(
            d["latency"].cast("double"), F.col("pressure"), F.col("score"), F.col("size"), d["byte_cost"], F.col("weight"), F.col("move_cost"),
            d["provider"] == F.col("current"), F.when(d["node"] != F.col("home"), d["hop"]).otherwise(0),
        )
        return F.struct(cost.alias("cost"), d["provider"].alias("provider"))

    rows = objects.join(F.broadcast(devices)).withColumn("costs", F.transform("devices", priced))  # one row for all
    rows = rows.withColumns({"best": F.array_min("costs"), "now": F.filter("costs", lambda c: c["provider"] == F.col("current"))[0]["cost"]})
    gain = (F.col("now") - F.col("best.cost")) / F.col("now")
    reason = F.when(F.col("since_move") < cooldown, "cooldown").when(F.col("best.provider") == F.col("current"), "best").when((F.col("now") > 0) & (gain < least_gain), "hysteresis").otherwise("move")
    rows = rows.withColumn("reason", reason)
    return rows.select("object", F.when(F.col("reason") == "move", F.col("best.provider")).otherwise(F.col("current")).alias("provider"), "reason")


def access_criticality(reads: Column, writes: Column, mlp: Column, stall: Column, critical: Column, tail: Column, size: Column) -> Column:
    """How much serial work an object's accesses are: their number by parallelism, weighted by where they lie, more for small objects."""
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    serial = (reads + writes) / F.least(F.greatest(mlp, F.lit(1.0)), F.lit(64.0))
    weight = 0.1 + 0.9 * unit(0.4 * unit(stall) + 0.4 * unit(critical) + 0.2 * unit(tail))
    return serial * weight * (1 + 8 / F.sqrt(F.greatest(size, F.lit(1)).cast("double")))


MAX_PLANS, PER_NODE, FACTOR, PER_SOURCE, PER_TARGET = 8, 2, 3, 4, 4


class Planner:
    """Moves of one cluster's replicas. nodes: id to (state, domain, weight); tablets: id to (replicas, whether a plan is live)."""

    def __init__(self, nodes: dict, tablets: dict):
        self.nodes, self.tablets, self.touched = nodes, tablets, {}
        self.eligible = sorted(n for n, (state, _, _) in nodes.items() if state == "Active")
        self.load = {n: 0 for n in nodes}
        for replicas, _ in tablets.values():
            for r in replicas:
                self.load[r] = self.load.get(r, 0) + 1

    def target(self, replicas: list[int], candidates: list[int]) -> int | None:
        """The candidate to add: of a domain not yet covered, then least loaded for its weight, least loaded, smallest."""
        covered = {self.nodes[r][1] for r in replicas if r in self.nodes}

        def rank(n):
            _, domain, weight = self.nodes[n]
            weight = max(weight, 1)
            return not (domain and domain not in covered), (self.load[n] * 1000 + weight - 1) // weight, self.load[n], n

        free = [n for n in candidates if n not in replicas and self.touched.get(n, 0) < PER_NODE]
        return min(free, key=rank, default=None)

    def _move(self, tablet: int, source: int, to: int) -> tuple:
        for n, more in ((source, -1), (to, 1)):
            self.touched[n] = self.touched.get(n, 0) + 1
            self.load[n] = self.load.get(n, 0) + more
        return tablet, source, to

    def rebalance(self) -> list[tuple]:
        """tablet, from, to: the most loaded holder gives a replica away where the target holds two fewer at least."""
        moves = []
        for tablet, (replicas, live) in sorted(self.tablets.items()):
            if len(moves) >= MAX_PLANS:
                break
            if live or len(replicas) != min(FACTOR, len(self.eligible)) or not replicas:
                continue
            source, to = min(replicas, key=lambda n: (-self.load[n], n)), self.target(replicas, self.eligible)
            if to is not None and self.load[source] - self.load[to] >= 2:
                moves.append(self._move(tablet, source, to))
        return moves

    def drain(self, node: int) -> list[tuple]:
        moves = []
        for tablet, (replicas, live) in sorted(self.tablets.items()):
            if len(moves) >= MAX_PLANS:
                break
            to = None if live or node not in replicas else self.target(replicas, [n for n in self.eligible if n != node])
            if to is not None:
                moves.append(self._move(tablet, node, to))
        return moves

    def repair(self) -> list[tuple]:
        """Replacements for failed replicas: tablets without a usable replica first, then those with the fewest."""
        failed, found = sorted(n for n, v in self.nodes.items() if v[0] == "Unavailable"), []
        for tablet, (replicas, live) in self.tablets.items():
            source = next((n for n in failed if n in replicas), None)
            usable = sum(self.nodes[r][0] in ("Active", "Suspect", "Draining") for r in replicas if r in self.nodes)
            if source is not None and not live and usable < max(min(FACTOR, max(len(replicas), 1)), len(replicas)):
                found.append((usable > 0, usable, tablet, source))
        moves, of_source, of_target = [], {}, {}
        for _, _, tablet, source in sorted(found):
            if len(moves) >= MAX_PLANS:
                break
            to = self.target(self.tablets[tablet][0], [n for n in self.eligible if of_target.get(n, 0) < PER_TARGET])
            if of_source.get(source, 0) < PER_SOURCE and to is not None:
                moves.append(self._move(tablet, source, to))
                of_source[source], of_target[to] = of_source.get(source, 0) + 1, of_target.get(to, 0) + 1
        return moves


def moves(nodes: DataFrame, tablets: DataFrame, kind: str) -> DataFrame:
    """cluster, ord, tablet, source, target: the moves of `kind` (rebalance, repair, drain: of each cluster's draining nodes) of clusters,
    from nodes (cluster, node, state, domain, weight) and tablets (cluster, tablet, replicas, live)."""

    def plan(key, nodes, tablets):
        import pyarrow as pa

        state = {n["node"]: (n["state"], n["domain"], n["weight"]) for n in nodes.to_pylist()}
        planner = Planner(state, {t["tablet"]: (t["replicas"], t["live"]) for t in tablets.to_pylist()})
        draining = sorted(n for n, v in state.items() if v[0] == "Draining")
        found = [m for n in draining for m in planner.drain(n)] if kind == "drain" else getattr(planner, kind)()
        cols = [[key[0].as_py()] * len(found), list(range(len(found))), *(zip(*found, strict=True) if found else ((), (), ()))]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["cluster", "ord", "tablet", "source", "target"])

    return nodes.groupBy("cluster").cogroup(tablets.groupBy("cluster")).applyInArrow(plan, "cluster long, ord long, tablet long, source long, target long")
