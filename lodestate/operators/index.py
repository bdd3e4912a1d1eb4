"""Secondary indexes: equality, range and unique lookup, each entry validated against the version of its primary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestate.operators.fold import ordered_fold


def _valid(entries: DataFrame, state: DataFrame) -> DataFrame:
    return entries.join(state.select(F.col("key").alias("primary"), "version", "value"), ["primary", "version"])


def equal(entries: DataFrame, state: DataFrame, term: str, limit: int) -> DataFrame:
    """Primaries whose entry under the term is current, in key order."""
    return _valid(entries.where(F.col("term") == term), state).select("primary", "value").orderBy("primary").limit(limit)


def term_range(entries: DataFrame, state: DataFrame, start: str, end: str, limit: int) -> DataFrame:
    """The first `limit` entries of [start, end) by (term, primary), then validated: stale ones leave gaps."""
    hits = entries.where((F.col("term") >= start) & (F.col("term") < end)).orderBy("term", "primary").limit(min(limit, 1000))
    return _valid(hits, state).select("term", "primary")


def claims(entries: DataFrame) -> DataFrame:
    """First claimer of each term of a unique index, and how many others are refused."""
    return entries.groupBy("term").agg(F.min_by("primary", "seq").alias("owner"), (F.count_distinct("primary") - 1).alias("refused"))


def stale(entries: DataFrame, state: DataFrame) -> DataFrame:
    """Entries to delete: their primary is gone or has another version."""
    return entries.join(state.select(F.col("key").alias("primary"), "version"), ["primary", "version"], "left_anti")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per primary the terms to put and to delete (arrays `terms`)."""
    both = before.select("primary", F.col("terms").alias("old")).join(after.select("primary", F.col("terms").alias("new")), "primary", "full")
    empty = F.array().cast("array<string>")
    old, new = F.coalesce("old", empty), F.coalesce("new", empty)
    return both.select("primary", F.array_except(new, old).alias("put"), F.array_except(old, new).alias("gone"))


def backfill(planned: DataFrame, state: DataFrame) -> DataFrame:
    """Entries (term, primary, version) of planned projections whose primary still has the expected version."""
    now = state.select(F.col("key").alias("primary"), "version")
    return planned.join(now, ["primary", "version"]).select(F.explode(F.array_distinct("terms")).alias("term"), "primary", "version")


def maintained(log: DataFrame) -> DataFrame:
    """seq, primary, version, put, gone of every indexed write (primary, seq, terms; null terms: a delete): the primary's version after
    it, and the entries put and deleted with it in one step. A delete deletes all entries, a set puts those of all its terms, since
    every entry carries the version."""
    w = Window.partitionBy("primary").orderBy("seq")
    rows = log.withColumn("life", F.sum(F.col("terms").isNull().cast("long")).over(w))
    none = F.array().cast("array<string>")
    before = F.coalesce(F.lag("terms").over(w), none)
    version = F.count("terms").over(Window.partitionBy("primary", "life").orderBy("seq"))
    now = F.array_distinct(F.coalesce("terms", none))
    return rows.withColumns({"before": before, "now": now}).select("seq", "primary", version.alias("version"), F.array_sort("now").alias("put"), F.array_sort(F.array_except("before", "now")).alias("gone"))


def entries_after(log: DataFrame) -> DataFrame:
    """term, primary, version: what the index holds after all writes. Only a primary's last write has entries."""
    last = maintained(log).groupBy("primary").agg(F.max_by(F.struct("version", "put"), "seq").alias("w"))
    return last.select(F.explode("w.put").alias("term"), "primary", "w.version")


def unique_outcomes(log: DataFrame) -> DataFrame:
    """seq, status of writes that each claim a term of a unique index (term, primary, seq): the first claimer owns it, others violate."""
    owner = log.groupBy("term").agg(F.min_by("primary", "seq").alias("owner"))
    return log.join(owner, "term").select("seq", F.when(F.col("primary") == F.col("owner"), "Ok").otherwise("UniqueViolation").alias("status"))


def equal_unique(asked: DataFrame, entries: DataFrame, state: DataFrame) -> DataFrame:
    """Each asked term with its owner, if the entry's version is the owner's; else null."""
    valid = _valid(entries, state).select("term", "primary")
    return asked.join(valid, "term", "left").select("term", "primary")


def resolve_values(keys: DataFrame, state: DataFrame) -> DataFrame:
    """key, value of keys (key, version) that still have that version; those that moved on are left out."""
    return keys.join(state.select("key", "version", "value"), ["key", "version"]).select("key", "value")


def catalog(log: DataFrame) -> DataFrame:
    """seq, status of steps (key: the index, seq, step) of an index's life: create, ready, drop, remove, each only after the one
    before; removed indexes may be created again. As a refused step changes nothing, steps fold in order."""
    return ordered_fold(log, Catalog, ["step"], "status string, state string")


class Catalog:
    """The life of one index: Building, Ready, Dropping, gone."""

    NEXT = {("create", None): "Building", ("ready", "Building"): "Ready", ("drop", "Building"): "Dropping", ("drop", "Ready"): "Dropping", ("remove", "Dropping"): None}

    def __init__(self):
        self.state = None

    def apply(self, step: str) -> tuple[str, str | None]:
        """status, state after."""
        if (step, self.state) not in self.NEXT:
            return "IllegalTransition", self.state
        self.state = self.NEXT[step, self.state]
        return "Ok", self.state
