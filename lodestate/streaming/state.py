"""Streaming forms: exactly-once operations and latest state from an operation stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exactly_once(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Retries of (session, req_seq) inside the watermark are dropped; event time is `ts`."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session", "req_seq"])


def windowed_rates(stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Requests by scope and tumbling window; late rows beyond the watermark are rejected."""
    return stream.withWatermark("ts", delay).groupBy("scope", F.window("ts", width)).agg(F.count(F.lit(1)).alias("requests"))


def latest_state(stream: DataFrame) -> DataFrame:
    """Last write of each key, in update mode: state is one row per key."""
    return stream.groupBy("key").agg(F.max_by(F.struct("op", "value", "expires_us"), "seq").alias("last"))


def machine_fold(stream: DataFrame, machine: type, columns: list[str], results: str) -> DataFrame:
    """`ordered_fold` over a stream: key, seq and the results of every operation, applied in order of seq to the machine that each key
    keeps between micro-batches. A key's operations must come in order from batch to batch; inside one they are sorted. The state
    store holds one pickled machine a key, so what a machine holds must be bounded (as streams, sessions and sketches are)."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [r.split()[0] for r in results.split(", ")]
    kinds = {"long": "Int64", "boolean": "boolean", "string": "object"}
    types = {r.split()[0]: kinds[r.split()[1]] for r in results.split(", ")}

    def run(key: tuple, batches, state: GroupState):
        import pickle

        held = pickle.loads(state.get[0]) if state.exists else machine()
        rows = pd.concat(list(batches)).sort_values("seq")
        plain = [[None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in rows[c]] for c in columns]
        if any(rows[c].dtype.kind == "f" for c in columns):  # whole numbers that pandas made floats of to hold nulls
            plain = [[int(v) if isinstance(v, float) else v for v in values] for values in plain]
        found = [held.apply(*arguments) for arguments in zip(*plain, strict=True)]
        state.update((pickle.dumps(held),))
        out = pd.DataFrame(found, columns=names).astype(types)
        out.insert(0, "key", key[0])
        out.insert(1, "seq", rows["seq"].to_numpy())
        yield out

    wanted = stream.select("key", "seq", *columns).groupBy("key")
    return wanted.applyInPandasWithState(run, f"key long, seq long, {results}", "machine binary", "append", GroupStateTimeout.NoTimeout)
