"""Limits of the reference that the given tables do not reach, by hand-made logs."""

import pytest

from lodestate import registry
from lodestate.operators import fold, txn

SF = "/root/testdata/sf0.001"
STREAM = "key long, seq long, op string, through long, partition_bytes long, payload_bytes long"


def test_stream_limits(spark):
    """1,024 retained entries and 64 KiB at most, refused appends take no offset, trims make room and never rewind."""
    big = 64 << 10
    log = [(0, 0, "append", None, 1, 1), (0, 1, "trim", 5, None, None), (0, 2, "create", None, None, None)]
    log += [(0, 3 + i, "append", None, 1, 9) for i in range(1026)]
    log += [(0, 1999, "create", None, None, None), (0, 2000, "trim", 1, None, None), (0, 2001, "append", None, 1, big + 1), (0, 2002, "append", None, big + 1, 1), (0, 2003, "append", None, big, big)]
    log += [(0, 2004, "append", None, 1, 1), (0, 2005, "append", None, 1, 1), (0, 2006, "trim", 5000, None, None), (0, 2007, "append", None, 1, 1)]
    got = {r["seq"]: r[2:] for r in fold.streams(spark.createDataFrame(log, STREAM)).orderBy("seq").collect()}
    assert got[0] == ("NotFound", None, None, 0, 0) and got[1] == ("Ok", None, 0, 0, 0) and got[2] == ("Ok", None, None, 0, 0)
    assert [got[3 + i][1] for i in range(1024)] == list(range(1024))
    assert got[1027] == got[1028] == ("StreamFull", None, None, 1024, 1024)
    assert got[1999] == ("WrongType", None, None, 1024, 1024)
    assert got[2000] == ("Ok", None, 2, 1024, 1022) and got[2001] == got[2002] == ("StreamFull", None, None, 1024, 1022)
    assert got[2003] == ("Ok", 1024, None, 1025, 1023) and got[2004] == ("Ok", 1025, None, 1026, 1024) and got[2005][0] == "StreamFull"
    assert got[2006] == ("Ok", None, 1024, 1026, 0) and got[2007] == ("Ok", 1026, None, 1027, 1)


def test_stream_outcomes(spark):
    """Hourly trims leave 49 entries behind; without them (sf0.01) a shard refuses after 1,024."""
    from lodestate.sources import oplog

    rows = registry.QUERIES["stream_outcomes"](spark, SF).collect()
    trims = [r for r in rows if r["op"] == "trim"]
    assert trims and all(r["retained"] <= 49 for r in trims) and any(r["removed"] for r in trims)
    assert sum(r["op"] == "append" and r["status"] == "Ok" for r in rows) == registry.QUERIES["stream_append"](spark, SF).count()
    full = fold.streams(oplog.stream_log(spark, "/root/testdata/sf0.01", keep=None)).where("status = 'Ok' and offset is not null")
    assert {r["key"]: r["count"] for r in full.groupBy("key").count().collect()} == dict.fromkeys(range(4), 1024)


@pytest.mark.parametrize("make", [
    f"SELECT event_id + i * 1000000 AS event_id, ts, user_id + i * 1000 AS user_id, event_type, value, props FROM read_parquet('{SF}/events.parquet'), range(8) r(i)",
    "SELECT i - 2500 AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(i) AS ts, i % 3 * 4 AS user_id, 'view' AS event_type, 1.0 AS value, '{}' AS props FROM range(5000) r(i)",
])
def test_stream_append_never_fills(spark, tmp_path, make):
    """Hours that come back in later copies of a table, and an hour with more events than a shard may hold: as its SQL, no event is
    lost, and no shard is near its limit."""
    import duckdb
    from lodestate.sources import oplog

    con = duckdb.connect()
    con.execute(f"copy ({make}) to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    found = con.execute(registry.ORACLE_SQL["stream_append"])
    names = [c[0] for c in found.description]
    want = sorted(found.fetchall())
    assert sorted(map(tuple, registry.QUERIES["stream_append"](spark, str(tmp_path)).select(names).collect())) == want and len(want) >= 5000
    full = fold.streams(oplog.stream_log(spark, str(tmp_path))).where("status = 'StreamFull'").count()
    most = fold.streams(oplog.stream_log(spark, str(tmp_path), block=512)).agg({"retained": "max"}).first()[0]
    assert full and most <= 49 + 512


def test_escrow_capacity(spark):
    """A recipient at its capacity takes nothing, a donor keeps what its value needs, and that is found first."""
    top = 2**63 - 1
    moves = [
        (0, 1, 50, 300, 0, 400, 400, 500), (1, 2, 101, 0, 0, 400, 400, 500), (2, 3, 100, 300, 0, 400, 400, 500), (3, 4, 100, 301, 0, 400, 400, 500),
        (4, 5, 401, 0, 0, 400, 400, 500), (5, 6, 0, 0, 0, 400, 400, 500), (6, 6, 50, 0, 0, 400, 400, 500), (7, 8, 1, 0, 0, 500, 500, 500), (8, 9, 2, 0, 0, 500, top - 1, top),
    ]
    names = "donor long, recipient long, amount long, donor_value long, donor_min long, donor_max long, recipient_max long, recipient_capacity long"
    got = {r["donor"]: r[2:] for r in txn.plan_escrow(spark.createDataFrame(moves, names)).collect()}
    assert got[0] == ("Ok", 350, 450) and got[1] == ("InvalidWrite", 400, 400) and got[2] == ("Ok", 300, 500) and got[3] == ("Conflict", 400, 400)
    assert got[4] == ("Conflict", 400, 400) and got[5] == ("InvalidWrite", 400, 400) and got[6] == ("Ok", 400, 400) and got[7] == ("InvalidWrite", 500, 500) and got[8] == ("InvalidWrite", 500, top - 1)


def test_escrow_outcomes(spark):
    rows = registry.QUERIES["escrow_outcomes"](spark, "/root/testdata/sf0.01").collect()
    assert {r["status"] for r in rows} == {"Ok", "Conflict", "InvalidWrite"}
    assert all(r["recipient_max"] <= 500 and r["donor_max"] + r["recipient_max"] == 800 for r in rows)


def test_session_floor_and_cap(spark):
    """A late retry of an acknowledged request is Expired, 1,024 outcomes without acknowledgement are the most."""
    log = [(0, 1, 1, 0), (0, 2, 1, 0), (0, 3, 2, 1), (0, 4, 1, 0), (0, 5, 2, 2), (0, 6, 3, 0)] + [(1, i, i, 0) for i in range(1, 1026)]
    log += [(1, 2000, 5, 0), (1, 2001, 1025, 1), (1, 2002, 1026, 1)]
    rows = fold.sessions(spark.createDataFrame(log, "key long, seq long, request long, ack long")).collect()
    got = {(r["key"], r["seq"]): (r["status"], r["answered"], r["floor"]) for r in rows}
    assert [got[0, i] for i in range(1, 7)] == [("Ok", 1, 0), ("Replay", 1, 0), ("Ok", 3, 1), ("Expired", None, 1), ("Expired", None, 1), ("Ok", 6, 1)]
    assert all(got[1, i] == ("Ok", i, 0) for i in range(1, 1025)) and got[1, 1025] == ("Overloaded", None, 0)
    assert got[1, 2000] == ("Replay", 5, 0) and got[1, 2001] == got[1, 2002] == ("Overloaded", None, 0)


def test_session_outcomes(spark):
    from lodestate.sources import oplog

    n = {r["status"]: r["count"] for r in registry.QUERIES["session_outcomes"](spark, SF).groupBy("status").count().collect()}
    sent = oplog.counter_log(spark, SF)
    again = {odd: sent.where(f"seq % 22 = {11 * odd}").count() for odd in (0, 1)}
    assert n["Ok"] == sent.count() and n["Replay"] + n["Expired"] == again[0] + again[1]
    assert n["Replay"] >= again[1] and n["Expired"] > 0  # a late retry near its session's end is not acknowledged yet
