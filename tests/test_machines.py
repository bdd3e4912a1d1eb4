"""State machines and planners by hand-made cases, and those against plain rewritings that SQL does not cover."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestate.operators import control, directory, erasure, fold, index, planner, scan, storage, txn
from lodestate.sources import oplog, workload

SF = "/root/testdata/sf0.001"


def test_lease_needs_owner_and_token():
    m = fold.Lease()
    assert m.apply("lease_acquire", 0, 7, 10, None, None)[0] == "Ok" and m.next == 2
    assert m.apply("lease_acquire", 5, 7, 10, None, None)[0] == "LeaseConflict"  # the holder itself too
    assert m.apply("lease_renew", 5, 7, 10, 9, None)[0] == "StaleFencing"
    assert m.apply("lease_renew", 5, 8, 10, 1, None)[0] == "StaleFencing"
    assert m.apply("lease_renew", 5, 7, 10, 1, None) == ("Ok", None, 1, 15, 2)
    assert m.apply("lease_renew", 15, 7, 10, 1, None)[0] == "StaleFencing"  # lapsed at its stamp
    assert m.apply("lease_release", 20, 7, 0, 1, None) == ("Ok", True, None, None, 2)  # lapsed, but the last grant
    assert m.apply("lease_release", 20, 7, 0, 1, None) == ("Ok", False, None, None, 2)
    assert m.apply("lease_acquire", 21, 8, 0, None, None) == ("Ok", None, 2, None, 3)
    assert m.apply("lease_release", 22, 7, 0, 1, None)[0] == "StaleFencing"
    assert m.apply("lease_release", 10**18, 8, 0, 2, None)[1] is True


def test_bounded_counter_rules():
    m = fold.Bounded()
    assert m.apply("add", 1, None, None)[0] == "BoundedExceeded" and m.apply("share", 0, 0, 1)[0] == "BoundedExceeded"
    assert m.apply("create", 2**63, None, None)[0] == "BoundedExceeded" and m.apply("create", 10, None, None) == ("Ok", 0, 0, 10, 1)
    assert m.apply("create", 10, None, None)[0] == "WrongType"
    assert m.apply("add", 11, None, None)[0] == m.apply("add", -1, None, None)[0] == "BoundedExceeded"
    assert m.apply("add", 2**63 - 1, None, None)[0] == "BoundedExceeded" and m.apply("add", 6, None, None)[1] == 6
    assert m.apply("add", 2**63 - 1, None, None)[0] == "CounterOverflow"
    assert m.apply("share", 0, 0, 5)[0] == "BoundedExceeded"  # does not cover the value
    assert m.apply("share", 0, 2, 8) == ("Ok", 6, 2, 8, 3) and m.apply("share", 0, 1, 8)[0] == "BoundedExceeded"  # never wider
    assert m.apply("add", 3, None, None)[0] == "BoundedExceeded" and m.apply("add", 2, None, None)[1] == 8


def test_semaphore_permits():
    m = fold.Semaphore()
    assert m.apply("acquire", 1, 1, 1)[0] == "NotFound" and m.apply("release", 1, 1, 1)[:2] == ("Ok", False)
    assert m.apply("create", None, None, 3)[0] == "Ok" and m.apply("create", None, None, 3)[0] == "WrongType"
    assert m.apply("acquire", 1, 1, 2)[2] == 2 and m.apply("acquire", 1, 1, 2) == ("Ok", None, 2, 3)  # the same again
    assert m.apply("acquire", 1, 2, 2)[0] == m.apply("acquire", 1, 1, 1)[0] == m.apply("acquire", 2, 1, 2)[0] == "SemaphoreExhausted"
    assert m.apply("acquire", 9, 1, 0) == ("Ok", None, 2, 3) and m.apply("release", 9, 1, 0)[1] is False  # nothing is stored
    assert m.apply("release", 1, 1, None) == ("Ok", True, 0, 3)


def test_sketch_bounds(spark):
    rng = random.Random(3)
    items = [min(int(rng.paretovariate(0.7)), 500) for _ in range(3000)]
    m, truth = fold.Sketch(20), {}
    for i in items:
        m.apply(i, i % 2 == 0, False, 5)
        truth[i] = truth.get(i, 0) + 1
    rows = m.rows()
    assert len(rows) == 20 and [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
    for _, item, estimate, bound, critical, tail, stall in rows:
        assert truth[item] <= estimate <= truth[item] + 3000 // 20 and bound == 150
        assert critical in (0, stall // 5) and tail == 0
    assert {i for i, n in truth.items() if n > 150} <= {r[1] for r in rows}
    small = fold.Sketch(2)
    for i in (3, 3, 1, 2):
        small.apply(i, False, False, 0)
    assert [(r[1], r[2]) for r in small.rows()] == [(2, 2), (3, 2)]  # 2 took the place and count of 1
    exact = fold.sketch(oplog.telemetry(spark, SF), 1000).groupBy("scope", "item").agg(F.first("estimate").alias("n"))
    counts = oplog.telemetry(spark, SF).groupBy("scope", "item").count()
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, counts.collect()))


def test_serial_batches(spark):
    w = lambda key, kind="Put", amount=1, expect="Any", version=0, bound=10: {"key": key, "kind": kind, "amount": amount, "expect": expect, "expect_version": version, "bound": bound, "bytes": 16}
    m = txn.Serial()
    assert m.apply([w(1, expect="Absent"), w(2)]) == ("Ok", 2)
    assert m.apply([w(3), w(1, expect="Absent")]) == ("TxnConflict", 0) and 3 not in m.state  # all or nothing
    assert m.apply([w(1, "CounterAdd", 5, "Version", 1)]) == ("Ok", 1) and m.state[1] == (6, 2)  # sees what the first left
    assert m.apply([w(1, "BoundedAdd", 5)]) == ("BoundedExceeded", 0) and m.apply([w(1, "CounterAdd", 2**63 - 1)]) == ("CounterOverflow", 0)
    assert m.apply([w(1), w(1, "Delete")]) == ("Ok", 1) and 1 not in m.state  # the last write to a key wins
    assert m.apply([w(k) for k in range(257)])[0] == "TooLarge" and m.apply([w(k) for k in range(256)])[0] == "Ok"
    assert m.apply([w(1) | {"bytes": (1 << 20) + 1}])[0] == "TooLarge"


def test_ledger_admits(spark):
    m = planner.Ledger()
    assert m.apply("a", "x", 1) == ("Ok", 1) and m.apply("a", "y", 3)[0] == "Duplicate" and m.apply("b", "x", 3)[0] == "Conflict"
    assert m.apply("a", "x", 4)[0] == "Ok"
    assert [m.apply(f"n{i}", f"c{i}", 9)[0] for i in range(10)] == ["Ok"] * 8 + ["RateLimit"] * 2


def test_planner_moves():
    nodes = {n: ("Active", f"d{n % 3}", 1) for n in range(4)}
    even = planner.Planner(nodes, {t: ([t % 4, (t + 1) % 4, (t + 2) % 4], False) for t in range(4)})
    assert even.rebalance() == []  # no move between equal loads
    skewed = planner.Planner(nodes, {t: ([0, 1, 2], t == 5) for t in range(6)})
    moves = skewed.rebalance()
    assert moves == [(0, 0, 3), (1, 1, 3)]  # two plans touch a node at most; a live plan keeps its tablet out
    heavy = planner.Planner(nodes | {3: ("Active", "d0", 8)}, {})
    heavy.load = {0: 1, 1: 1, 2: 1, 3: 4}
    assert heavy.target([2], [0, 1, 3]) == 3  # load by weight
    assert planner.Planner({**nodes, 3: ("Draining", "d9", 1)}, {1: ([0, 1, 3], False), 2: ([0, 1, 2], False)}).drain(3) == [(1, 3, 2)]
    failed = {**nodes, 0: ("Unavailable", "d0", 1), 4: ("Unavailable", "d4", 1)}
    plan = planner.Planner(failed, {1: ([0, 1, 2], False), 2: ([0, 4], False), 3: ([0, 1, 2], True), 4: ([1, 2, 3], False)})
    assert plan.repair() == [(2, 0, 1), (1, 0, 3)]  # the tablet without a usable replica goes first


def test_directory_steps(spark):
    assert sorted(map(tuple, directory.static_tiles(spark, 3).collect())) == [(3, "1"), (4, "00"), (5, "01")]
    with pytest.raises(ValueError):
        directory.static_tiles(spark, 0)
    assert {r["bits"] for r in directory.static_tiles(spark, 5).collect()} == {"01", "10", "11", "000", "001"}
    rows = [(1, "", "m", "Tombstone", [2, 3]), (2, "", "c", "Tombstone", [4, 5]), (3, "c", "m", "Active", None), (4, "", "b", "Active", None), (5, "b", "c", "Active", None), (6, "m", None, "Active", None)]
    d = spark.createDataFrame(rows, "tablet long, start_key string, end_key string, state string, redirect array<long>")
    assert sorted(map(tuple, directory.successors(d).collect())) == [(1, 3), (1, 4), (1, 5), (2, 4), (2, 5)]
    assert directory.coverage_complete(d).first()["complete"] and directory.violations(d).isEmpty()
    assert not directory.coverage_complete(d.where("tablet <> 5")).first()["complete"]
    assert directory.cutover(d, spark.sql("select array(3L) as parents, array(6L) as children")).exceptAll(d).isEmpty()  # nothing is fenced
    keys = spark.createDataFrame([("a", 1), ("bb", 2), ("d", 1)], "key string, tablet long")
    assert sorted(map(tuple, directory.route_retired(keys, d).collect())) == [("a", 1, 4), ("bb", 2, 5), ("d", 1, 3)]


def test_erasure_from_any_fragments(spark):
    rng = random.Random(1)
    for size in (0, 1, 7, 64, 1001):
        value = rng.randbytes(size)
        parts = erasure.fragments(value, 4, 2)
        assert b"".join(parts[:4])[:size] == value
        for _ in range(15):
            held = {i: parts[i] for i in rng.sample(range(6), 4)}
            assert erasure.value_of(held, 4, 2, size) == value
    with pytest.raises(ValueError):
        erasure.value_of({0: b"x"}, 4, 2, 1)


def test_spread_prefers_new_domains(spark):
    assets = spark.range(50).withColumnRenamed("id", "asset")
    nodes = spark.createDataFrame([(n, f"r{n % 4}") for n in range(8)], "node long, domain string")
    for _, rows in itertools.groupby(sorted(map(tuple, control.spread(assets, nodes, 6).collect())), key=lambda r: r[0]):
        own = [r[2] for r in rows]
        assert len({n % 4 for n in own[:4]}) == 4 and len(set(own)) == 6  # then the least loaded nodes


def test_linear_scorer_steps():
    """Each weight moves by error * feature * rate, cut to whole parts, against the error that the weights before it leave."""
    m = fold.Linear(2)
    assert m.apply([100, 1], 5000) == (0, 44955) and m.weights == [500, -45]  # 5000 * 100 / 1000, then -45000 / 1000
    assert m.apply([0, -1], 0) == (45, 45000) and m.weights == [500, -45]  # -45 * -1 / 1000 is cut to nothing
    m.weights = [m.LARGEST, 0]
    m.apply([1, 0], 2**62)
    assert m.weights == [m.LARGEST, 0]


def test_catalog_and_phases():
    c = index.Catalog()
    assert [c.apply(s)[0] for s in ("ready", "create", "create", "ready", "drop", "ready", "remove", "create")] == ["IllegalTransition", "Ok", "IllegalTransition", "Ok", "Ok", "IllegalTransition", "Ok", "Ok"]
    p = planner.Phases()
    steps = ["ChildrenProvisioning", "Fenced", "BaseSeeded", "Fenced", "BaseSeeded", "Fenced", "ChildrenReady", "BaseSeeded", "CutoverCommitted", "Failed", "Failed", "Planned"]
    assert [p.apply("split", s)[0] for s in steps] == ["Ok", "IllegalTransition", *["Ok"] * 5, "IllegalTransition", "Ok", "Ok", "Ok", "IllegalTransition"]
    m = planner.Phases()
    m.phase = "SourceRetiring"
    assert m.apply("migration", "Completed")[0] == "Ok" and m.apply("migration", "Failed")[0] == "IllegalTransition"


def test_payloads_and_workloads(spark):
    state, want = workload.PAYLOAD_SEED, b""
    for _ in range(3):
        state = (state + 0x9E3779B97F4A7C15) % 2**64
        z = state
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
        want += (z ^ (z >> 31)).to_bytes(8, "little")
    assert workload.payload(20) == want[:20] and workload.payload(0) == b""
    hot = workload.operations(spark, "mixed", 8, None).collect()
    assert {r["key"] for r in hot} == {"hot", "hot:c"}
    own = workload.operations(spark, "get", 6, 3, threads=2).collect()
    assert {r["key"] for r in own} == {f"t{t}k{i}" for t in range(2) for i in range(3)} and len(own) == 12


def test_scan_splits_and_routes(spark):
    rng = random.Random(7)
    for keys in ([], ["a"], ["a", "b"], ["k" * n for n in range(1, 9)], [f"{rng.randrange(10**6):06d}x" for _ in range(200)]):
        rows = [(k, "v" * rng.randrange(30)) for k in sorted(set(keys))]
        df = spark.createDataFrame(rows, "key string, value string")
        total, reached, want = sum(len(k) + len(v) for k, v in rows), 0, None
        for k, v in rows[1:]:
            reached += len(k) + len(v)
            if want is None and 2 * reached >= total:
                want = k
        got = [r["split_key"] for r in scan.median_split(df).collect()]
        assert got == ([] if not rows else [want])
    tablets = spark.createDataFrame([(1, "", "c"), (2, "c", "m"), (3, "n", None)], "tablet long, start_key string, end_key string")
    df = spark.createDataFrame([("a",), ("c",), ("mm",), ("z",)], "key string")
    assert {r["key"]: r["tablet"] for r in scan.route(df, tablets).collect()} == {"a": 1, "c": 2, "z": 3}


def test_bands_are_rewritten_alone(spark, tmp_path):
    path = str(tmp_path / "bands")
    state = spark.range(200).select(F.col("id").alias("key"), F.lit("old").alias("value")).withColumn("hash", directory.route_hash(1, F.col("key").cast("string")))
    storage.write_bands(state, path)
    dirty = state.where("key < 5").select(storage.band(F.col("hash")).alias("band")).distinct()
    storage.write_bands(state.withColumn("value", F.lit("new")), path, dirty)
    found = storage.read_bands(spark, path).collect()
    bands = {r["band"] for r in dirty.collect()}
    assert len(found) == 200 and all((r["value"] == "new") == (int(r["hash"][:2], 16) in bands) for r in found)
    assert np.unique([r["key"] for r in found]).size == 200
