"""Atomic batches: all or nothing, optimistic expectations, one decision for each transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestate.operators.fold import ordered_fold

#: Age from which an undecided intent is aborted.
GRACE_US = 2_000_000


def collapse(writes: DataFrame) -> DataFrame:
    """Duplicate writes of a key inside a batch: the last one wins (of equal places, the larger delta)."""
    return writes.groupBy("txn", "key").agg(F.max_by(F.struct("delta", "expect", "expect_version"), F.struct("ord", "delta")).alias("w")).select("txn", "key", "w.*")


def check(writes: DataFrame, state: DataFrame) -> DataFrame:
    """Each collapsed write with `ok`: its expectation (Any, Absent, Version) against the state."""
    seen = collapse(writes).join(state.select("key", "version"), "key", "left")
    ok = (
        F.when(F.col("expect") == "Any", True)
        .when(F.col("expect") == "Absent", F.col("version").isNull())
        .otherwise(F.col("version").eqNullSafe(F.col("expect_version")))
    )
    return seen.withColumn("ok", ok)


def outcomes(writes: DataFrame, state: DataFrame) -> DataFrame:
    """txn, status, keys: Ok only when every write of the batch holds."""
    return check(writes, state).groupBy("txn").agg(F.bool_and("ok").alias("ok"), F.count(F.lit(1)).alias("n_keys")).select("txn", F.when(F.col("ok"), "Ok").otherwise("TxnConflict").alias("status"), "n_keys")


def committed_totals(writes: DataFrame, state: DataFrame) -> DataFrame:
    """Sum of the deltas of committed batches by key. The batch's verdict is a window over its own writes (256 at most)."""
    whole = F.bool_and("ok").over(Window.partitionBy("txn"))
    return check(writes, state).withColumn("whole", whole).where("whole").groupBy("key").agg(F.sum("delta").alias("total"))


def coordinators(writes: DataFrame, tablets: int) -> DataFrame:
    """Participants of each batch by tablet, the lowest one as coordinator."""
    at = writes.select("txn", F.pmod(F.col("route"), F.lit(tablets)).alias("tablet")).distinct()
    return at.groupBy("txn").agg(F.min("tablet").alias("coordinator"), F.count(F.lit(1)).alias("participants"))


def decisions(votes: DataFrame) -> DataFrame:
    """The first decision of a transaction is final; later different ones are conflicts."""
    return votes.groupBy("txn").agg(F.min_by("decision", "seq").alias("decision"), (F.count_distinct("decision") > 1).alias("conflict"))


def plan_escrow(moves: DataFrame) -> DataFrame:
    """moves (donor, recipient, amount, donor_value, and of both: min, max, capacity) with the status of each and both upper
    shares after. The donor must keep what its value needs, the recipient must stay within its capacity; to itself nothing moves."""
    amount, largest = F.col("amount"), F.lit(2**63 - 1)
    donor, recipient = F.col("donor_max") - amount, F.col("recipient_max") + amount
    overflows = (F.col("donor_max") < F.lit(-(2**63)) + amount), (F.col("recipient_max") > largest - amount)
    status = (
        F.when((amount <= 0) | overflows[0], "InvalidWrite").when((donor < F.col("donor_min")) | (F.col("donor_value") > donor), "Conflict")
        .when(overflows[1], "InvalidWrite").when(recipient > F.col("recipient_capacity"), "InvalidWrite").otherwise("Ok")
    )
    moved = (F.col("status") == "Ok") & (F.col("donor") != F.col("recipient"))
    after = {"donor_max": F.when(moved, donor).otherwise(F.col("donor_max")), "recipient_max": F.when(moved, recipient).otherwise(F.col("recipient_max"))}
    return moves.withColumn("status", status).withColumns(after).select("donor", "recipient", "status", "donor_max", "recipient_max")


def escrow_conserved(shares: DataFrame) -> DataFrame:
    """Whether the widths of all shares of a batch add up to the same before and after."""
    return shares.groupBy("txn").agg((F.sum("before") == F.sum("after")).alias("conserved"))


def write_set_digest(writes: DataFrame) -> DataFrame:
    """SHA-256 of each batch's collapsed writes in key order: the order of arrival and the expectations do not matter. A batch
    holds 256 keys at most, which bounds the list."""
    text = F.format_string("%010d=%d", "key", "delta")
    return collapse(writes).groupBy("txn").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), ";").cast("binary"), 256).alias("digest"))


def blocked(log: DataFrame) -> DataFrame:
    """Mutations and reads of a key between an intent (op prepare) and its end (op decide): mutations conflict, reads see
    the committed state."""
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.last(F.when(F.col("op").isin("prepare", "decide"), F.col("op") == "prepare"), True).over(w), F.lit(False))
    rows = log.withColumn("held", held).where("op in ('mutate', 'read')")
    return rows.select("key", "seq", F.when(F.col("held") & (F.col("op") == "mutate"), "TxnConflict").otherwise("Ok").alias("status"))


def resolve(intents: DataFrame, records: DataFrame, now_us: int, grace_us: int = GRACE_US) -> DataFrame:
    """What becomes of each intent: finalized or released by its decision, aborted without one after the grace, else kept."""
    seen = intents.join(records.select("txn", "decision"), "txn", "left")
    late = F.lit(now_us) - F.col("prepared_us") > grace_us
    return seen.select("txn", F.when(F.col("decision") == "Committed", "Finalize").when(F.col("decision") == "Aborted", "Release").when(late, "Abort").otherwise("Wait").alias("action"))


def two_phase(writes: DataFrame, state: DataFrame, tablets: int, most: int = 32) -> DataFrame:
    """txn, tablet, coordinator, vote, decision, action: batches across tablets. Each participant votes by its own writes'
    expectations, the lowest tablet coordinates, one No aborts; participants then finalize or release. A batch of more than `most`
    participants is rejected before anything is prepared."""
    routed = writes.select("txn", "key", F.pmod(F.col("route"), F.lit(tablets)).alias("tablet")).groupBy("txn", "key").agg(F.max("tablet").alias("tablet"))
    votes = check(writes, state).select("txn", "key", "ok").join(routed, ["txn", "key"]).groupBy("txn", "tablet").agg(F.bool_and("ok").alias("yes"))
    w = Window.partitionBy("txn")
    rows = votes.withColumns({"coordinator": F.min("tablet").over(w), "all_yes": F.bool_and("yes").over(w), "n": F.count(F.lit(1)).over(w)})
    decision = F.when(F.col("n") > most, "Rejected").when(F.col("all_yes"), "Committed").otherwise("Aborted")
    rows = rows.withColumn("decision", decision)
    vote = F.when(F.col("decision") == "Rejected", F.lit(None)).when(F.col("yes"), "Prepared").otherwise("Conflict")
    action = F.when(F.col("decision") == "Committed", "Finalize").when((F.col("decision") == "Aborted") & F.col("yes"), "Release")
    return rows.select("txn", "tablet", "coordinator", vote.alias("vote"), "decision", action.alias("action"))


def overlay(ops: DataFrame) -> DataFrame:
    """seq, own, committed of every read (key, batch, seq, value; a read's value is null): what the batch itself sees, its writes before
    the read over what earlier batches left, and what everyone else sees meanwhile."""
    in_batch = Window.partitionBy("key", "batch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    staged = F.last("value", True).over(in_batch)
    ends = ops.groupBy("key", "batch").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("seq"))).alias("left"))
    before = F.last("left", True).over(Window.partitionBy("key").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("key", "batch", before.alias("committed"))
    reads = ops.withColumn("staged", staged).where("value is null")
    return reads.join(ends, ["key", "batch"]).select("seq", F.coalesce("staged", "committed").alias("own"), "committed")


class Serial:
    """A partition of the keyspace that batches run over one after another, each seeing what those before it left."""

    MAX_KEYS, MAX_BYTES = 256, 1 << 20

    def __init__(self):
        self.state: dict = {}

    def apply(self, writes: list[dict]) -> tuple[str, int]:
        """status, keys written; a batch applies whole or not at all."""
        last = {w["key"]: w for w in writes}  # of writes to one key the last wins
        if len(last) > self.MAX_KEYS or sum(w["bytes"] for w in last.values()) > self.MAX_BYTES:
            return "TooLarge", 0
        after = {}
        for key, w in last.items():
            value, version = self.state.get(key, (None, 0))
            if not (w["expect"] == "Any" or (w["expect"] == "Absent" and version == 0) or (w["expect"] == "Version" and version == w["expect_version"])):
                return "TxnConflict", 0
            if w["kind"] == "Delete":
                after[key] = None
                continue
            new = w["amount"] if w["kind"] == "Put" else (value or 0) + w["amount"]
            if w["kind"] == "BoundedAdd" and not 0 <= new <= w["bound"]:
                return "BoundedExceeded", 0
            if not -(2**63) <= new < 2**63:
                return "CounterOverflow", 0
            after[key] = new, version + 1
        for key, found in after.items():
            if found is None:
                self.state.pop(key, None)
            else:
                self.state[key] = found
        return "Ok", len(after)


def serial(batches: DataFrame) -> DataFrame:
    """key, seq, status, applied of batches (key: the partition they run in, seq, writes: array of structs) in order of seq. A batch
    spans no partitions; two_phase is for those that do."""
    return ordered_fold(batches, Serial, ["writes"], "status string, applied long")
