"""Ordered range scans with limits and byte budgets, splits, statistics and routing of keys to tablets."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_ITEMS, MAX_BYTES = 10_000, 4 << 20


def scan_range(state: DataFrame, start: str, end: str | None, limit: int, reverse: bool = False, keys_only: bool = False) -> DataFrame:
    """[start, end) in key order; the filters reach the parquet scan, the limit is a top-k of each task."""
    if limit <= 0 or (end is not None and start >= end):
        raise ValueError("an empty range or budget")
    rows = state.where(F.col("key") >= start)
    rows = rows if end is None else rows.where(F.col("key") < end)
    rows = rows.select("key", "version") if keys_only else rows.select("key", "value", "version")
    return rows.orderBy(F.desc("key") if reverse else F.asc("key")).limit(min(limit, MAX_ITEMS))


def within_budget(page: DataFrame, budget: int) -> DataFrame:
    """A page's rows up to the byte budget: the first row that overflows stops it; one that overflows an empty page is
    `Oversize`. page is at most one page (MAX_ITEMS rows), so one window over it is small."""
    w, budget = Window.orderBy("key"), min(budget, MAX_BYTES)
    size = F.octet_length("value").cast("long")
    total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = page.withColumns({"total": total, "n": F.row_number().over(w)})
    return rows.where(f"total <= {budget} or n = 1").select("key", F.when(F.col("total") <= budget, "Ok").otherwise("Oversize").alias("status"), "total")


def page_cursor(page: DataFrame) -> DataFrame:
    """Where the next page starts: right behind the last key."""
    return page.agg(F.concat(F.max("key"), F.lit("\0")).alias("next_cursor"), F.count(F.lit(1)).alias("items"))


def pages(state: DataFrame, start: str, size: int, count: int) -> DataFrame:
    """The first `count` pages of `size` rows from start on, with their number: each page resumes at the cursor of the one before, so
    keys may move between partitions meanwhile."""
    out, at = [], start
    for n in range(count):
        page = scan_range(state, at, None, size).withColumn("page", F.lit(n).cast("long"))
        out.append(page)
        cursor = page_cursor(page).first()["next_cursor"]
        if cursor is None:
            break
        at = cursor
    return functools.reduce(DataFrame.unionByName, out)


def median_split(state: DataFrame, bits: int = 4) -> DataFrame:
    """The first key at which the bytes from the second key on reach half of all. Totals by key prefix find the prefix that holds the
    split; prefixes grow, `bits` characters a step, until that prefix is one key, so no step sorts more than the prefixes of one."""
    sized = state.select("key", (F.octet_length(F.encode("key", "utf-8")) + F.octet_length("value")).cast("long").alias("size"))
    whole = sized.agg(F.sum("size").alias("total"), F.min(F.struct("key", "size")).alias("head"), F.max(F.length("key")).alias("longest")).first()
    if whole["total"] is None:
        return sized.select(F.col("key").alias("split_key")).limit(0)
    rest, before, prefix, n = sized.where(F.col("key") > F.lit(whole["head"]["key"])), 0, "", 0
    while n < whole["longest"]:
        n += bits
        groups = rest.where(F.col("key").startswith(prefix)).groupBy(F.substring("key", 1, n).alias("prefix")).agg(F.sum("size").alias("bytes"))
        running = F.sum("bytes").over(Window.orderBy("prefix"))  # of one prefix's longer prefixes
        found = groups.withColumn("reached", F.lit(before) + running).where(F.col("reached") * 2 >= whole["total"]).orderBy("prefix").first()
        if found is None:
            return sized.select(F.lit(None).cast("string").alias("split_key")).limit(1)
        prefix, before = found["prefix"], found["reached"] - found["bytes"]
    return sized.sparkSession.createDataFrame([(prefix,)], "split_key string")


def stats(state: DataFrame) -> DataFrame:
    return state.agg(F.count(F.lit(1)).alias("object_count"), F.sum(F.octet_length("key")).alias("key_bytes"), F.sum(F.octet_length("value")).alias("value_bytes"))


MAX_TABLETS = 1_000_000


def route(state: DataFrame, tablets: DataFrame) -> DataFrame:
    """Each key with the tablet whose [start_key, end_key) holds it. A directory is small, which is checked, so its sorted starts go to
    every task, which finds the last one at or below each key by binary search."""
    rows = [(t["start_key"] or "", t["end_key"], t["tablet"]) for t in tablets.select("start_key", "end_key", "tablet").limit(MAX_TABLETS + 1).collect()]
    if len(rows) > MAX_TABLETS:
        raise ValueError(f"a directory has {MAX_TABLETS} tablets at most")
    rows.sort(key=lambda r: r[0].encode())
    starts, ends, numbers = [r[0].encode() for r in rows], [r[1] and r[1].encode() for r in rows], [r[2] for r in rows]

    def run(batches):
        import bisect

        import pyarrow as pa

        for b in batches:
            keys = [k.encode() for k in b["key"].to_pylist()]
            at = [bisect.bisect_right(starts, k) - 1 for k in keys]
            own = [numbers[i] if i >= 0 and (ends[i] is None or k < ends[i]) else None for i, k in zip(at, keys, strict=True)]
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(own, pa.int64())], names=["key", "tablet"])

    return state.select("key").mapInArrow(run, "key string, tablet long").where("tablet is not null")
