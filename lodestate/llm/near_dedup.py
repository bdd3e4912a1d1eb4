"""MinHash near-dedup with sequential Bayesian verification.

1. Each text becomes the set of its word shingles (64-bit hashes), a MinHash signature of BANDS * ROWS values of which one
   byte each is kept, and BANDS band keys. Texts with equal sets (128-bit digest) are one class with one representative.
2. Candidates are representatives that share a band key. Their signatures are compared batch by batch; after each batch a
   pair is pruned when the posterior probability that its similarity reaches the threshold, under a uniform prior and the
   matches so far, is below MISS (`least_matches` tabulates that bound).
3. Survivors are verified exactly, on the full shingle sets.

Links inside one component need not all be found to know the component, so candidates come in three rounds: (a) each bucket's
members against its smallest id; (b) in buckets that still hold several components, each member's best candidate in another
component; (c) every remaining candidate across components. What (c) leaves out is only pairs already connected: no link
between components is lost but by the miss probabilities (a pair of similarity 0.8 shares no band with probability 5e-8).

Scale: signatures and texts move only for documents in buckets with two members or more; buckets stream through a task sorted
by key. A hot centre's comparisons are dealt in blocks of CENTRE_BLOCK members, and those of the later rounds in blocks
of BLOCK_SETS documents against the union of their candidates, so no row is ever made for each pair of a group. Signatures
of a bucket are compared in blocks of PROPOSERS proposing by MEMBERS other members, each in its own task. Components come from
alternating minimum-label steps over verified links, in DataFrame joins.

Sets are compared by 64-bit hashes of their shingles (a polynomial over word hashes, scrambled): two different shingles of a pair
of documents with s shingles in all share one with probability s^2 / 2^65, 3e-12 for texts of 10,000 words.

Defined cases: null or empty text has an empty set and no link; fewer words than a shingle: the whole sequence is one shingle;
rows that repeat a doc_id, or have none, are documents of their own, in the order of (doc_id, text), nulls last; component_id is the
doc_id of a component's first row, which alone is kept; an empty table gives an empty result; extra columns are untouched.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_groups, keyed, materialize, tune
from .textops import hash_texts, mix, rolling

SHINGLE_WORDS = 5
THRESHOLD = 80  # percent
BANDS, ROWS = 32, 4
#: Hashes compared before each look at the posterior.
BATCH = 16
MISS = 1e-7
CENTRE_BLOCK = 512
#: A block of later comparisons: sets held at once, and texts of one candidate list that stream past them.
BLOCK_SETS, BLOCK_TEXTS = 128, 256
#: Members of a bucket dealt to a task that looks for candidates across components: proposing ones and others, and how many of the
#: others are compared at once.
PROPOSERS, MEMBERS, MET = 4096, 1024, 8192
#: Shingles hashed at once for a signature.
BLOCK = 4096


@functools.cache
def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for h in hash_texts([t.encode() for t in texts], lower=True):
        s = rolling(h, words) if len(h) >= words else mix(rolling(h, len(h)) + np.uint64(len(h)))
        out.append(np.unique(s) if len(h) else np.empty(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima, uint32, of multiply-shift hashes folded to their high bits."""
    a, b = _coefficients()
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), BLOCK):
        h = x[at : at + BLOCK] * a[:, None] + b[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(low, h.min(axis=1), out=low)
    return low


@functools.cache
def least_matches(threshold: float = THRESHOLD / 100, miss: float = MISS) -> tuple[int, ...]:
    """For each number of compared batches, the fewest matching bytes that keep a pair. A byte matches with probability
    s + (1 - s)/256; the posterior of s >= threshold given m of n matches is integrated over a uniform prior."""
    s = np.linspace(0, 1, 2001)
    p = np.clip(s + (1 - s) / 256, 1e-12, 1 - 1e-12)
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(log - log.max())
            if w[s >= threshold - 1e-9].sum() / w.sum() >= miss:
                break
        out.append(m)
    return tuple(out)


def survivors(one: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of `many` (bytes) survive against `one`, and their matches."""
    alive, matches = np.arange(len(many)), np.zeros(len(many), np.int64)
    for k, least in enumerate(least_matches()):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (many[alive, part] == one[part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive, matches[alive]


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key, sig (bytes), bands (array of long)."""
    tune(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n, key, sig, bands = [], [], [], []
            for s in shingle_sets(b["text"].to_pylist(), words):
                full = signature(s)
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(full.astype(np.uint8).tobytes())
                h = np.arange(BANDS, dtype=np.uint64)
                for r in full.reshape(BANDS, ROWS).T:
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + r)
                bands.append(h.view(np.int64))
            flat = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), lists], names=["doc_id", "n_shingles", "set_key", "sig", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>")


def verify(pairs: DataFrame, docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """Of pairs (a, b), those whose full shingle sets reach the threshold: a, b."""
    loads = pairs.groupBy("a").count().select("a", F.expr(f"(count + {CENTRE_BLOCK - 1}) div {CENTRE_BLOCK}").alias("blocks"))
    loads = materialize(loads, "loads")
    members = pairs.join(loads, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), F.col("b").alias("doc_id"), F.lit(1).alias("side"))
    centres = loads.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("a").alias("doc_id"), F.lit(0).alias("side"))
    rows = members.unionByName(centres).join(docs, "doc_id")
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", "side", "doc_id").select("a", "block", "side", "doc_id", "text")

    def run(batches):
        import pyarrow as pa

        centre, own = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            sets = shingle_sets(batch["text"].to_pylist(), words)
            for c, block, side, d, s in zip(*(batch[x].to_pylist() for x in ("a", "block", "side", "doc_id")), sets, strict=True):
                if side == 0:
                    centre, own = (c, block), s
                elif (c, block) == centre:
                    common = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * common >= threshold * (len(own) + len(s) - common):
                        a.append(c), b.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, label) of every linked document: the smallest id reachable. Minimum labels spread over links and through the
    labels themselves (pointer jumping), so long chains end after logarithmically many rounds."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "links")
    held = labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "doc_id"), "labels")
    while True:
        near = both.join(labels.select(F.col("doc_id").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        step = labels.join(near, labels["doc_id"] == near["a"]).select("doc_id", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        step = materialize(step, "step")
        up = step.select(F.col("doc_id").alias("label"), F.col("label").alias("up"))
        after = step.join(up, "label", "left").select("doc_id", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        spread = materialize(after, "labels")
        discard(held, step)
        held, labels = spread, spread.select("doc_id", "label")
        if spread.where("label <> old").isEmpty():
            discard(both)
            return labels


def _across(named: DataFrame, sigs: DataFrame, best_only: bool) -> DataFrame:
    """u, its surviving candidates vs in other components of a bucket, and the bucket's smallest id as home, from the buckets
    (key, doc_id, label) that hold several components. The bucket's largest component proposes nothing: its pairs come up from
    the others. best_only: each member's best candidate in each part of the bucket. A bucket's proposing members are dealt into
    blocks and its members into parts; a task holds the signatures of one block and streams one part past it, so neither its memory
    nor its rows grow with the bucket."""
    sizes = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
    mixed = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("n", -F.col("label"))).alias("largest"), F.expr(f"ceil((sum(n) - max(n)) / {PROPOSERS})").alias("blocks"), F.expr(f"ceil(sum(n) / {MEMBERS})").alias("parts"), F.min("least").alias("home"))
    rows = named.join(mixed.where("labels > 1").drop("labels"), "key").join(sigs, "doc_id")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    block, part = (F.pmod(F.xxhash64("doc_id", F.lit(n)), F.col(n)) for n in ("blocks", "parts"))  # tasks are block + blocks * part
    met = F.transform(upto("blocks"), lambda b: F.struct((b + F.col("blocks") * part).alias("block"), F.lit(1).alias("side")))
    own = F.transform(upto("parts"), lambda p: F.struct((block + F.col("blocks") * p).alias("block"), F.lit(0).alias("side")))
    rows = rows.withColumn("place", F.explode(F.when(F.col("label") != F.col("largest"), F.concat(own, met)).otherwise(met)))
    rows = rows.select("key", "place.block", "place.side", "doc_id", "label", "largest", "home", "sig")
    rows = rows.repartition("key", "block").sortWithinPartitions("key", "block", "side", "doc_id")

    def run(batches):
        import pyarrow as pa

        block, met, best, at, largest, home = [], [], {}, None, None, None

        def compare():
            ids, labels = (np.array([m[k] for m in met], np.int64) for k in (0, 1))
            sigs = np.frombuffer(b"".join(m[2] for m in met), np.uint8).reshape(len(met), -1)
            met.clear()
            for u, label, sig in block:
                rest = np.flatnonzero((labels != label) & ((labels == largest) | (ids > u) | best_only))
                alive, matches = survivors(np.frombuffer(sig, np.uint8), sigs[rest])
                if len(alive) and best_only:
                    top = matches.argmax()
                    if matches[top] > best.get(u, (-1, 0))[0]:
                        best[u] = int(matches[top]), int(ids[rest[alive[top]]])
                elif len(alive):
                    yield u, ids[rest[alive]].tolist(), home

        def finish():
            if met:
                yield from compare()
            for u, (_, v) in best.items():
                yield u, [v], home
            block.clear(), best.clear()

        def batch_of(found):
            u, vs, homes = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(vs, pa.list_(pa.int64())), pa.array(homes, pa.int64())], names=["u", "vs", "home"])

        for batch in batches:
            found = []
            for k, b, side, d, label, top, least, sig in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, b) != at:
                    found += finish()
                    at, largest, home = (k, b), top, least
                if side == 0:
                    block.append((d, label, sig))
                    continue
                met.append((d, label, sig))
                if len(met) == MET:
                    found += compare()
            yield batch_of(found)
        yield batch_of(list(finish()))

    return rows.mapInArrow(run, "u long, vs array<long>, home long")


def verify_blocks(proposed: DataFrame, docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """Of proposals (u, vs, home), the pairs (a, b) whose full sets reach the threshold. Documents of one home are dealt into blocks that
    hold the sets of a few hundred u, and the vs of a block into parts, each block and part in its own task; the text of a v goes to a
    task once, however many u it is compared with."""
    each = proposed.groupBy("u").agg(F.array_distinct(F.flatten(F.collect_list("vs"))).alias("vs"), F.min("home").alias("home"))
    each = materialize(each, "each")
    loads = each.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.expr(f"ceil(count(*) / {BLOCK_SETS})").alias("blocks"), F.expr(f"ceil(max(size(vs)) / {BLOCK_TEXTS})").alias("parts"))
    each = join_groups(each, materialize(loads, "loads"), ["home"], "n", each.count())
    part_of = lambda v: F.pmod(F.xxhash64(v), F.col("parts"))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.filter("vs", lambda v: part_of(v) == p).alias("vs")))
    dealt = each.select("home", "u", "blocks", F.explode(F.filter(parts, lambda x: F.size(x["vs"]) > 0)).alias("p"))
    dealt = dealt.select("home", (F.pmod(F.xxhash64("u"), F.col("blocks")) + F.col("blocks") * F.col("p.part")).alias("block"), "u", F.col("p.vs").alias("vs"))
    own = dealt.select("home", "block", F.col("u").alias("doc_id"), "vs")
    other = dealt.groupBy("home", "block").agg(F.array_distinct(F.flatten(F.collect_list("vs"))).alias("all"))
    other = other.select("home", "block", F.explode("all").alias("doc_id"), F.lit(None).cast("array<long>").alias("vs"))
    rows = own.unionByName(other).join(docs, "doc_id").withColumn("side", F.col("vs").isNull().cast("int"))
    rows = rows.repartition("home", "block").sortWithinPartitions("home", "block", "side", "doc_id").select("home", "block", "side", "doc_id", "vs", "text")

    def run(batches):
        import pyarrow as pa

        at, held, wanted = None, {}, {}
        for batch in batches:
            a, b = [], []
            sets = shingle_sets(batch["text"].to_pylist(), words)
            for home, block, side, d, vs, s in zip(*(batch[c].to_pylist() for c in ("home", "block", "side", "doc_id", "vs")), sets, strict=True):
                if (home, block) != at:
                    at, held, wanted = (home, block), {}, {}
                if side == 0:
                    held[d] = s
                    for v in vs:
                        wanted.setdefault(v, []).append(d)
                    continue
                for u in wanted.get(d, ()):
                    one = held[u]
                    if 100 * min(len(one), len(s)) < threshold * max(len(one), len(s)):
                        continue
                    common = len(np.intersect1d(one, s, assume_unique=True))
                    if 100 * common >= threshold * (len(one) + len(s) - common):
                        a.append(min(u, d)), b.append(max(u, d))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    rows, renumbered = keyed(docs.select(F.col("doc_id").cast("long"), "text"))
    found = grouped(rows, words, threshold)
    if not renumbered:
        return found
    own = rows.select(F.col("_doc").alias("row"), F.col("doc_id").alias("own_id"))
    first = own.select(F.col("row").alias("first_row"), F.col("own_id").alias("first_id"))
    found = found.join(own, F.col("doc_id") == F.col("row")).join(first, F.col("component_id") == F.col("first_row"))
    return found.select(F.col("own_id").alias("doc_id"), "n_shingles", F.col("first_id").alias("component_id"), "kept")


def grouped(rows: DataFrame, words: int, threshold: int) -> DataFrame:
    """near_duplicates of rows with a `_doc` each, which stands for doc_id in the result."""
    texts = rows.select(F.col("_doc").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = materialize(profiles(texts, words), "profiles")
    sets = known.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = known.join(sets, (known["doc_id"] == sets["rep"]) & (known["set_key"] == sets["set_key"]), "left_semi")
    reps = materialize(reps.select("doc_id", "sig", "bands"), "reps")
    banded = reps.select(F.explode("bands").alias("key"), "doc_id")
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = materialize(banded.join(shared, "key"), "members")
    sigs = reps.select("doc_id", "sig")
    # The texts shuffle once, to those of bucket members; a merge join at every size, so that the cost grows with the input.
    one_text = materialize(texts.join(members.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "texts")

    star = members.where("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = star.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")

    def prune(batches):
        import pyarrow as pa

        limits = np.array(least_matches())
        for b in batches:
            if not b.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
            alive = np.arange(b.num_rows)
            matches = np.zeros(b.num_rows, np.int64)
            for k, least in enumerate(limits):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (one[alive, part] == two[alive, part]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield b.select(["a", "b"]).take(pa.array(alive))

    tested = materialize(star.select("a", "b", "sig_a", "sig_b").mapInArrow(prune, "a long, b long"), "star")
    links = materialize(verify(tested, one_text, words, threshold), "links")
    labels, used = components(links), [tested, one_text, members, reps, links]
    for best_only in (True, False):
        named = members.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        proposed = materialize(_across(named, sigs, best_only), "proposed")
        used.append(proposed)
        if proposed.isEmpty():
            break
        links = materialize(links.unionByName(verify_blocks(proposed, one_text, words, threshold)), "links")
        used.append(links)
        labels = components(links)
    discard(*used)

    of_set = sets.join(labels, sets["rep"] == labels["doc_id"], "left").select("set_key", "copies", F.coalesce("label", "rep").alias("component_id"))
    found = join_groups(known.select("doc_id", "n_shingles", "set_key"), materialize(of_set, "sets"), ["set_key"], "copies", known.count(), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def near_dedup(docs: DataFrame, words: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs that stay, with all their columns: one row of each component."""
    rows, _ = keyed(docs)
    gone = grouped(rows, words, threshold).where("not kept").select(F.col("doc_id").alias("_doc"))
    return rows.join(gone, "_doc", "left_anti").drop("_doc").toDF(*docs.columns)
