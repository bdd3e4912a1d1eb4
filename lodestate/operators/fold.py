"""Folding an operation log into versioned, expiring state.

`versions` is the closed form for whole-value writes: a write opens a new life where the key had none, was deleted or had
expired; the version counts writes within the life. It is one sort by (key, seq), and all windows share it.

`ordered_fold` runs typed operations whose acceptance depends on the state before (bounded counters, leases, semaphores,
splices) one by one per key in Arrow batches sorted by key. A key's operations are ordered by definition, so a key is the unit of
parallelism, and its operations stream past its state, however many they are.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestate.functions.dialect import is_live

WRITES = ("set", "set_ex", "delete")


def versions(log: DataFrame) -> DataFrame:
    """key, seq, now_us, life, version, value, expires_us, until_seq (of the next write of the key) for every set."""
    w = Window.partitionBy("key").orderBy("seq")
    writes = log.where(F.col("op").isin(*WRITES)).withColumns(
        {"before": F.lag("op").over(w), "before_expires": F.lag("expires_us").over(w), "until_seq": F.lead("seq").over(w)}
    )
    starts = (F.col("op") != "delete") & (
        F.col("before").isNull() | (F.col("before") == "delete") | ~is_live(F.col("before_expires"), F.col("now_us"))
    )
    lives = writes.withColumn("life", F.sum(starts.cast("long")).over(w))
    sets = lives.where("op <> 'delete'")
    return sets.select("key", "seq", "now_us", "life", F.row_number().over(Window.partitionBy("key", "life").orderBy("seq")).cast("long").alias("version"), "value", "expires_us", "until_seq")


def latest(log: DataFrame) -> DataFrame:
    """The last write of each key that is a set: key, value, version, expires_us. The sort that numbers versions tells it too."""
    return versions(log).where("until_seq is null").select("key", "value", "version", "expires_us")


def counter(log: DataFrame) -> DataFrame:
    """key, seq, value after each add: a running sum since the last delete."""
    w = Window.partitionBy("key").orderBy("seq")
    lives = log.withColumn("life", F.sum((F.col("op") == "delete").cast("long")).over(w))
    adds = lives.where("op = 'add'")
    within = Window.partitionBy("key", "life").orderBy("seq")
    return adds.select("key", "seq", F.sum("delta").over(within).alias("value"), F.row_number().over(within).cast("long").alias("version"))


class Bounded:
    """A counter in [0, capacity] whose holder owns the share [low, high] of that range."""

    LARGEST = 2**63 - 1

    def __init__(self):
        self.state = None

    def apply(self, op: str, amount: int, low: int | None, high: int | None) -> tuple:
        """status, value, low, high, version (all after the operation, null where there is no counter)."""
        status = "Ok"
        if op == "create":
            if self.state:
                status = "WrongType"
            elif amount > self.LARGEST:
                status = "BoundedExceeded"
            else:
                self.state = [0, 0, amount, amount, 1]
        elif op == "drop":
            self.state = None
        elif op != "get":
            status = self._change(op, amount, low, high)
        return (status, *((None,) * 4 if not self.state else (self.state[0], *self.state[1:3], self.state[4])))

    def _change(self, op: str, amount: int, low: int | None, high: int | None) -> str:
        if not self.state:
            return "BoundedExceeded"
        value, least, most, capacity, version = self.state
        if op == "add":
            after = value + amount
            if not -self.LARGEST - 1 <= after <= self.LARGEST:
                return "CounterOverflow"
            if not max(0, least) <= after <= min(capacity, most):
                return "BoundedExceeded"
            self.state[0] = after
        else:  # a share can only be narrowed, and must cover the value
            if low < least or high > most or not 0 <= low <= value <= high <= capacity:
                return "BoundedExceeded"
            self.state[1:3] = low, high
        self.state[4] = version + 1
        return "Ok"


class Counter:
    """A 64-bit counter: an addition that overflows is refused without effect, a delete ends it."""

    def __init__(self):
        self.value, self.version = None, 0

    def apply(self, op: str, delta: int) -> tuple:
        """status, value and version after."""
        if op == "delete":
            self.value, self.version = None, 0
            return "Ok", None, 0
        after = (self.value or 0) + delta
        if not -(2**63) <= after < 2**63:
            return "CounterOverflow", self.value, self.version
        self.value, self.version = after, self.version + 1
        return "Ok", self.value, self.version


class Conditional:
    """Bytes with conditional sets: `condition` Always, IfAbsent or IfPresent, `expiry` Clear, Keep or At."""

    def __init__(self):
        self.value, self.version, self.expires = None, 0, None

    def apply(self, op: str, now: int, value: str | None, condition: str | None, expiry: str | None, at: int | None) -> tuple:
        """applied, and after the operation version, value, expires_us."""
        if self.value is not None and self.expires is not None and now >= self.expires:
            self.value, self.version, self.expires = None, 0, None
        live = self.value is not None
        applied = live if op == "delete" else condition == "Always" or (condition == "IfPresent") == live
        if op == "delete":
            self.value, self.version, self.expires = None, 0, None
        elif applied:
            self.expires = at if expiry == "At" else self.expires if expiry == "Keep" else None
            self.value, self.version = value, self.version + 1
        return applied, self.version, self.value, self.expires


class Lease:
    """A fenced lease: a live holder blocks everyone, itself too; each grant has the next token. Renewals need the live grant's
    owner and token, releases those of the last grant, live or lapsed. A ttl of 0 never lapses; others end after 100 years."""

    LONGEST = 100 * 365 * 86_400 * 1_000_000

    def __init__(self):
        self.holder, self.next = None, 1

    def apply(self, op: str, now: int, owner: int, ttl: int, token: int | None, behind: int | None) -> tuple:
        """status, released (of a release), token and expires_us of the holder after, next token. Without a token the caller has
        that of `behind` grants before the last one."""
        status, released = "Ok", None
        token = self.next - 1 - behind if token is None and behind is not None else token
        holder = self.holder
        live = holder is not None and (holder[2] is None or now < holder[2])
        until = None if ttl == 0 else now + min(ttl or 0, self.LONGEST)
        if op == "lease_acquire":
            if live:
                status = "LeaseConflict"
            else:
                self.holder, self.next = (owner, self.next, until), self.next + 1
        elif op == "lease_renew":
            if live and holder[:2] == (owner, token):
                self.holder = (owner, token, until)
            else:
                status = "StaleFencing"
        elif holder is None:
            released = False
        elif holder[:2] == (owner, token):
            self.holder, released = None, True
        else:
            status = "StaleFencing"
        return status, released, *((None, None) if self.holder is None else self.holder[1:]), self.next


class Spliced:
    """Bytes with a version: whole writes, splices, reads of a range."""

    def __init__(self):
        self.value, self.version = None, 0

    def apply(self, op: str, value: str | None, offset: int | None) -> tuple:
        """applied, version and value_hex after the operation, read_hex (of a read, else null). An empty patch writes too."""
        live, read, applied = self.value is not None, None, True
        if op == "set":
            self.value, self.version = value.encode(), self.version + 1
        elif op == "delete":
            applied = live
            self.value, self.version = None, 0
        elif op == "set_range":
            patch, old = value.encode(), self.value or b""
            self.value, self.version = old[:offset].ljust(offset, b"\0") + patch + old[offset + len(patch) :], self.version + 1
        else:
            applied = live
            read = self.value[offset : offset + int(value)].hex().upper() if live else None
        return applied, self.version, None if self.value is None else self.value.hex().upper(), read


class Semaphore:
    """Counted permits under a capacity, each known by its id; MAX_PERMITS are held at most."""

    MAX_PERMITS = 4096

    def __init__(self):
        self.capacity, self.held, self.used = None, {}, 0

    def apply(self, op: str, permit: int | None, owner: int | None, qty: int | None) -> tuple:
        """status, released (of a release), and used and capacity after."""
        status, released = "Ok", None
        if op == "create":
            if self.capacity is None:
                self.capacity = qty
            else:
                status = "WrongType"
        elif op == "release":
            released = permit in self.held
            if released:
                self.used -= self.held.pop(permit)[1]
        elif self.capacity is None:
            status = "NotFound"
        elif op == "acquire" and qty:
            if permit in self.held:
                status = "Ok" if self.held[permit] == (owner, qty) else "SemaphoreExhausted"
            elif len(self.held) >= self.MAX_PERMITS or self.used + qty > self.capacity:
                status = "SemaphoreExhausted"
            else:
                self.held[permit] = (owner, qty)
                self.used += qty
        return status, released, self.used, self.capacity


class Stream:
    """A shard of a stream: offsets rise by one with each accepted append, a trim drops the retained entries up to an offset."""

    MAX_ENTRIES, MAX_BYTES = 1024, 64 << 10

    def __init__(self):
        self.first, self.next = None, 0

    def apply(self, op: str, through: int | None, partition_bytes: int | None, payload_bytes: int | None) -> tuple:
        """status, offset (of an accepted append), removed (by a trim), next_offset, retained (both after the operation).
        trim_behind drops through the next offset less `through`, as a client does that has just read the shard."""
        status, offset, removed = "Ok", None, None
        if op == "create":
            if self.first is None:
                self.first = 0
            else:
                status = "WrongType"
        elif op == "append":
            if self.first is None:
                status = "NotFound"
            elif max(partition_bytes, payload_bytes) > self.MAX_BYTES or self.next - self.first >= self.MAX_ENTRIES:
                status = "StreamFull"
            else:
                offset, self.next = self.next, self.next + 1
        else:
            keep = (self.next - through if op == "trim_behind" else through) + 1
            before, removed = self.first, 0
            if before is not None:
                self.first = min(max(before, keep), self.next)
                removed = self.first - before
        return status, offset, removed, self.next, self.next - (self.next if self.first is None else self.first)


class Session:
    """Outcomes of a client session that it has not acknowledged yet; MAX_OUTCOMES are retained at most."""

    MAX_OUTCOMES = 1024

    def __init__(self):
        self.floor, self.outcomes = 0, {}

    def apply(self, request: int, ack: int, seq: int) -> tuple:
        """status, the seq whose outcome is answered, floor after. A request is judged by its own acknowledgement too, but that
        frees outcomes and raises the floor only if the request is admitted."""
        if request <= max(self.floor, ack):
            return "Expired", None, self.floor
        if request in self.outcomes:
            return "Replay", self.outcomes[request], self.floor
        if len(self.outcomes) >= self.MAX_OUTCOMES:
            return "Overloaded", None, self.floor
        if ack > self.floor:
            self.floor = ack
            self.outcomes = {r: at for r, at in self.outcomes.items() if r > ack}
        self.outcomes[request] = seq
        return "Ok", seq, self.floor


def ordered_fold(log: DataFrame, machine: type, columns: list[str], results: str) -> DataFrame:
    """key, seq and the results of every operation, applied in order of seq to one machine for each key. Rows stream through a
    task sorted by key and seq, so only the state of one key is held, however many operations it has."""

    def run(batches):
        import pyarrow as pa

        names, key, state = [r.split()[0] for r in results.split(", ")], None, None
        for batch in batches:
            keys, out = batch["key"].to_pylist(), []
            for k, *arguments in zip(keys, *(batch[c].to_pylist() for c in columns), strict=True):
                if state is None or k != key:
                    key, state = k, machine()
                out.append(state.apply(*arguments))
            found = zip(names, zip(*out, strict=True) if out else [()] * len(names), strict=True)
            yield pa.RecordBatch.from_pydict({"key": batch["key"], "seq": batch["seq"]} | {n: pa.array(v, kinds[n]) for n, v in found})

    import pyarrow as pa

    arrow = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    kinds = {r.split()[0]: arrow[r.split()[1]] for r in results.split(", ")}
    rows = log.select("key", "seq", *columns).repartition("key").sortWithinPartitions("key", "seq")
    return rows.mapInArrow(run, f"key long, seq long, {results}")


def expiry_edits(log: DataFrame) -> DataFrame:
    """key, seq, applied, version, expires_us, value of sets, deletes, expire_at and persist (key, seq, now_us, op, value, at_us; the last
    four columns as after the operation).

    No fold is needed: between one write and the next an object can only die once, at the first operation whose time has reached the
    stamp that the operation before it left, and it stays dead. So death is a running maximum, a life starts at a set that finds
    nothing alive, and the version counts the operations of a life that changed something. All windows are dealt by key."""
    w = Window.partitionBy("key").orderBy("seq")
    write = F.col("op").isin("set", "delete")
    rows = log.withColumns({"segment": F.sum(write.cast("long")).over(w), "stamp": F.when(F.col("op") != "persist", F.col("at_us"))})
    part = Window.partitionBy("key", "segment").orderBy("seq")
    rows = rows.withColumns({"held": F.lag("stamp").over(part), "first": F.first("op").over(part)})
    lapsed = ~write & F.col("held").isNotNull() & (F.col("now_us") >= F.col("held"))
    dead = F.max(lapsed).over(part) | (F.col("first") == "delete") | (F.col("segment") == 0)
    rows = rows.withColumn("dead", dead)
    before = F.lag(F.struct("dead", "stamp")).over(w)
    alive = before.isNotNull() & ~before["dead"] & (before["stamp"].isNull() | (F.col("now_us") < before["stamp"]))  # just before the operation
    rows = rows.withColumn("alive", F.coalesce(alive, F.lit(False)))
    rows = rows.withColumn("life", F.sum(((F.col("op") == "set") & ~F.col("alive")).cast("long")).over(w))
    applied = F.when(F.col("op") == "set", True).when(F.col("op") == "persist", F.col("alive") & F.col("held").isNotNull()).otherwise(F.col("alive"))
    rows = rows.withColumn("applied", applied)
    counted = F.sum((F.col("applied") & (F.col("op") != "delete")).cast("long")).over(Window.partitionBy("key", "life").orderBy("seq"))
    value = F.first("value").over(part)
    rows = rows.withColumns({"counted": counted, "written": value})
    here = lambda c: F.when(~F.col("dead"), F.col(c))
    return rows.select("key", "seq", "applied", F.coalesce(here("counted"), F.lit(0)).alias("version"), here("stamp").alias("expires_us"), here("written").alias("value"))


def splices(log: DataFrame) -> DataFrame:
    """Splices, whole writes and reads of ranges: the outcome of every operation."""
    return ordered_fold(log, Spliced, ["op", "value", "offset"], "applied boolean, version long, value_hex string, read_hex string")


def semaphores(log: DataFrame) -> DataFrame:
    """The outcome of every create, acquire, release and inspect of semaphores."""
    return ordered_fold(log, Semaphore, ["op", "permit", "owner", "qty"], "status string, released boolean, used long, capacity long")


def recover(checkpoint: DataFrame, tail: DataFrame) -> DataFrame:
    """key, value, version, expires_us after the log's tail, from the state (those columns) at its floor. A checkpointed object is the
    first write of its life, and that life's versions go on from its own."""
    base = checkpoint.select("key", F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("long").alias("now_us"), F.lit("set_ex").alias("op"), "value", "expires_us")
    after = versions(base.unionByName(tail.select("key", "seq", "now_us", "op", "value", "expires_us"))).where("until_seq is null")
    old = checkpoint.select("key", (F.col("version") - 1).alias("more"))
    version = F.col("version") + F.when(F.col("life") == 1, F.coalesce("more", F.lit(0))).otherwise(0)
    return after.join(old, "key", "left").select("key", "value", version.alias("version"), "expires_us")


class Linear:
    """A linear scorer over integer features, taught one sample after another: each weight moves against the error that the weights
    before it leave, cut to whole numbers."""

    RATE_PPM, LARGEST = 1_000, 2**31 - 1

    def __init__(self, size: int = 3):
        self.weights, self.bias, self.residual = [0] * size, 0, 0

    def score(self, features: list[int]) -> int:
        return sum(w * f for w, f in zip(self.weights, features, strict=True)) + self.bias

    def apply(self, features: list[int], target: int) -> tuple[int, int]:
        """the score before the sample, and the sum of absolute errors after it."""
        before = self.score(features)
        for i, f in enumerate(features):
            step = (target - self.score(features)) * f * self.RATE_PPM
            step = step // 1_000_000 if step >= 0 else -(-step // 1_000_000)
            step = max(-self.LARGEST - 1, min(self.LARGEST, step))
            self.weights[i] = max(-self.LARGEST - 1, min(self.LARGEST, self.weights[i] + step))
        self.residual += abs(target - self.score(features))
        return before, self.residual


def taught(samples: DataFrame) -> DataFrame:
    """key, seq, score, residual of samples (key: the model, seq, features: array, target)."""
    return ordered_fold(samples, Linear, ["features", "target"], "score long, residual long")


def leases(log: DataFrame) -> DataFrame:
    """The outcome of every lease operation."""
    return ordered_fold(log, Lease, ["op", "now_us", "owner", "ttl_us", "token", "behind"], "status string, released boolean, token long, expires_us long, next_token long")


def bounded(log: DataFrame) -> DataFrame:
    """The outcome of every operation on bounded counters."""
    return ordered_fold(log, Bounded, ["op", "amount", "low", "high"], "status string, value long, low long, high long, version long")


def bounded_add(log: DataFrame, capacity: int) -> DataFrame:
    """key, value, accepted, rejected: of additions (key, seq, delta) those that would leave [0, capacity] are rejected."""
    adds = log.select("key", "seq", F.lit("add").alias("op"), F.col("delta").alias("amount"))
    creates = log.groupBy("key").agg((F.min("seq") - 1).alias("seq"), F.lit("create").alias("op"), F.lit(capacity).cast("long").alias("amount"))
    share = F.lit(None).cast("long")
    done = bounded(adds.unionByName(creates).withColumns({"low": share, "high": share}))
    accepted, every = F.count_if(F.col("status") == "Ok") - 1, F.count(F.lit(1)) - 1  # less the create
    return done.groupBy("key").agg(F.max_by("value", "seq").alias("value"), accepted.alias("accepted"), (every - accepted).alias("rejected"))


def counters(log: DataFrame) -> DataFrame:
    """The outcome of every addition and delete of 64-bit counters, overflow checked."""
    return ordered_fold(log, Counter, ["op", "delta"], "status string, value long, version long")


def conditional(log: DataFrame) -> DataFrame:
    """The outcome of every conditional set and delete."""
    return ordered_fold(log, Conditional, ["op", "now_us", "value", "condition", "expiry", "at_us"], "applied boolean, version long, value string, expires_us long")


def streams(log: DataFrame) -> DataFrame:
    """The outcome of every create, append and trim of a stream's shards."""
    return ordered_fold(log, Stream, ["op", "through", "partition_bytes", "payload_bytes"], "status string, offset long, removed long, next_offset long, retained long")


def sessions(log: DataFrame) -> DataFrame:
    """The answer to every attempt of every session's requests (key: the session)."""
    return ordered_fold(log.withColumn("at", F.col("seq")), Session, ["request", "ack", "at"], "status string, answered long, floor long")


class Sketch:
    """Space-saving heavy hitters: `capacity` keys are held; a new one takes the place and count of the least frequent (of equal ones
    the smallest key) and starts its evidence anew. An estimate exceeds the truth by total // capacity at most."""

    def __init__(self, capacity: int = 16):
        self.capacity, self.entries, self.total = capacity, {}, 0

    def apply(self, item: int, critical: bool, tail: bool, stall: int) -> None:
        self.total += 1
        entry = self.entries.get(item)
        if entry is None:
            count = 0
            if len(self.entries) >= self.capacity:
                gone = min(self.entries, key=lambda k: (self.entries[k][0], k))
                count = self.entries.pop(gone)[0]
            entry = self.entries[item] = [count, 0, 0, 0]
        for place, more in enumerate((1, critical, tail, stall)):
            entry[place] += more

    def rows(self) -> list[tuple]:
        """rank, item, estimate, error bound, critical and tail hits, stall: the highest estimates first."""
        order = sorted(self.entries.items(), key=lambda e: (-e[1][0], e[0]))
        return [(n + 1, item, e[0], self.total // self.capacity, *e[1:]) for n, (item, e) in enumerate(order)]


def final_fold(log: DataFrame, machine, columns: list[str], results: str) -> DataFrame:
    """key and the results of `machine().rows()` after all of a key's operations, applied in order of seq. Keys stream through a task,
    so only the state of one is held."""

    def run(batches):
        import pyarrow as pa

        key, state, out = None, None, []
        names = [r.split()[0] for r in results.split(", ")]

        def batch_of(rows):
            held = list(zip(*rows, strict=True)) or [()] * (1 + len(names))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held], names=["key", *names])

        for batch in batches:
            for k, *arguments in zip(*(batch[c].to_pylist() for c in ("key", *columns)), strict=True):
                if state is None or k != key:
                    out += [(key, *r) for r in state.rows()] if state else []
                    key, state = k, machine()
                state.apply(*arguments)
            yield batch_of(out)
            out = []
        yield batch_of([(key, *r) for r in state.rows()] if state else [])

    rows = log.select("key", "seq", *columns).repartition("key").sortWithinPartitions("key", "seq")
    return rows.mapInArrow(run, f"key long, {results}")


def sketch(samples: DataFrame, capacity: int) -> DataFrame:
    """What a bounded sketch of each scope retains of its samples (scope, sequence, item, critical, tail, stall)."""
    log = samples.withColumnsRenamed({"scope": "key", "sequence": "seq"})
    held = final_fold(log, functools.partial(Sketch, capacity), ["item", "critical", "tail", "stall"], "rank long, item long, estimate long, error_bound long, critical long, tail long, stall long")
    return held.withColumnRenamed("key", "scope")


def exactly_once(log: DataFrame, session: str, request: str, order: str) -> DataFrame:
    """The first row of each (session, request): later ones replay its outcome. Pre-aggregated before the shuffle."""
    rest = [c for c in log.columns if c not in (session, request)]
    first = log.groupBy(session, request).agg(F.min_by(F.struct(*rest), order).alias("r"), F.count(F.lit(1)).alias("attempts"))
    return first.select(session, request, "r.*", "attempts")


# The type that each typed read needs.
READS = {"get": "bytes", "counter_get": "counter", "bounded_get": "bounded", "stream_read": "stream"}


def typed_reads(requests: DataFrame, state: DataFrame) -> DataFrame:
    """id, status, answer of requests (id, key, op) on typed objects (key, kind, value, number): a read of another type is WrongType, of
    nothing null (a bounded counter refuses that too), and exists asks for any type."""
    seen = requests.join(state, "key", "left")
    wanted = F.coalesce(*(F.when(F.col("op") == op, kind) for op, kind in READS.items()))
    there, any_type = F.col("kind").isNotNull(), F.col("op") == "exists"
    status = F.when(any_type, "Ok").when(~there, F.when(F.col("op") == "bounded_get", "BoundedExceeded").otherwise("Ok")).when(F.col("kind") != wanted, "WrongType").otherwise("Ok")
    answer = F.when(any_type, there.cast("string")).when(there & (F.col("kind") == wanted), F.when(F.col("op") == "get", F.col("value")).otherwise(F.col("number").cast("string")))
    return seen.select("id", status.alias("status"), answer.alias("answer"))


def descriptors(state: DataFrame) -> DataFrame:
    """key, descriptor of typed objects: the length of bytes, the number of others."""
    return state.select("key", F.concat_ws(":", "kind", F.when(F.col("kind") == "bytes", F.octet_length("value").cast("long")).otherwise(F.col("number"))).alias("descriptor"))


def linear_score(weights: list[int], bias: int, features) -> Column:
    products = F.zip_with(F.array(*(F.lit(w).cast("long") for w in weights)), features, lambda w, f: w * f)
    return F.aggregate(products, F.lit(bias).cast("long"), lambda a, x: a + x)
