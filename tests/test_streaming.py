"""Streaming forms over a directory of Parquet files, run until what is there is read."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lodestate.operators import fold
from lodestate.sources import oplog
from lodestate.streaming import state

START = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, rows, schema, form, mode, name):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = form(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_retries_are_dropped(spark, tmp_path):
    rows = [(START, 1, 1, 5), (START, 1, 1, 5), (START, 1, 2, 6), (START, 2, 1, 7), (START, 2, 1, 7)]
    got = run(spark, tmp_path, rows, "ts timestamp, session long, req_seq long, delta long", state.exactly_once, "append", "retries")
    assert sorted((r["session"], r["req_seq"], r["delta"]) for r in got) == [(1, 1, 5), (1, 2, 6), (2, 1, 7)]


def test_windowed_rates(spark, tmp_path):
    rows = [(START + dt.timedelta(minutes=m), s) for m, s in ((0, 1), (59, 1), (60, 1), (61, 2))]
    got = run(spark, tmp_path, rows, "ts timestamp, scope long", state.windowed_rates, "update", "rates")
    assert sorted((r["scope"], r["window"]["start"], r["requests"]) for r in got) == [(1, START, 2), (1, START + dt.timedelta(hours=1), 1), (2, START + dt.timedelta(hours=1), 1)]


def test_latest_state(spark, tmp_path):
    rows = [(1, 1, "set", "a", None), (1, 2, "delete", None, None), (2, 3, "set", "b", 9), (2, 4, "set", "c", None)]
    got = run(spark, tmp_path, rows, "key long, seq long, op string, value string, expires_us long", state.latest_state, "complete", "latest")
    assert sorted((r["key"], r["last"]["op"], r["last"]["value"]) for r in got) == [(1, "delete", None), (2, "set", "c")]


@pytest.mark.parametrize(
    ("log", "machine", "columns", "results", "batch"),
    [
        (oplog.lease_log, fold.Lease, ["op", "now_us", "owner", "ttl_us", "token", "behind"], "status string, released boolean, token long, expires_us long, next_token long", fold.leases),
        (oplog.semaphore_log, fold.Semaphore, ["op", "permit", "owner", "qty"], "status string, released boolean, used long, capacity long", fold.semaphores),
        (oplog.conditional_log, fold.Conditional, ["op", "now_us", "value", "condition", "expiry", "at_us"], "applied boolean, version long, value string, expires_us long", fold.conditional),
    ],
)
def test_streamed_folds_equal_batch(spark, tmp_path, log, machine, columns, results, batch):
    """Three micro-batches of a log give what one batch gives."""
    rows = log(spark, "/root/testdata/sf0.001")
    schema = rows.schema
    cut = rows.agg(F.percentile_approx("seq", [0.3, 0.6])).first()[0]
    for i, (low, high) in enumerate(zip([-(10**9), *cut], [*cut, 10**18], strict=True)):
        rows.where((F.col("seq") > low) & (F.col("seq") <= high)).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"part{i}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i}-{f.name}")
            os.utime(tmp_path / "in" / f"{i}-{f.name}", (1000 + i, 1000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"fold_{machine.__name__.lower()}"
    q = state.machine_fold(stream, machine, columns, results).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got, want = (sorted(map(repr, map(tuple, df.collect()))) for df in (spark.table(name), batch(rows)))
    assert got == want and len(q.recentProgress) >= 3
