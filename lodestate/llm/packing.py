"""Best-fit packing by the sum of squares: documents into sequences of a fixed number of tokens.

Only a document longer than a sequence is cut, into full pieces and one shorter first piece. A full piece is a sequence of
its own. Every other piece goes where the sum of squares, over the residual gaps, of the number of open bins with that gap
becomes smallest (ties: the smallest gap left); opening a bin is one of the choices. The order of the pieces matters to the rule:
it needs a mix of lengths to balance gaps, and short pieces at the end to close them. Two orders are tried, by descending length
throughout, and shuffled down to an eighth of a sequence, then descending; the one with fewer sequences stays.

Scale: pieces are dealt to groups of about `group_pieces` by a hash of their document and number, and each group is
packed alone in one task, which holds (id, piece, length) of its pieces only. What a group loses to the bound of its total length
is some tens of sequences, whatever its size.

Defined cases: null text counts as empty (one piece of one token, the end id); repeated rows of a doc_id are packed each
for itself; an empty table gives no pieces; other columns of the input are not read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tune

SEQUENCE_TOKENS = 2048
END_ID = 0
GROUP_PIECES = 60_000

PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece, from the ids of each whole text and the end id."""
    tune(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .token_cache import encoder

        enc = encoder(tokenizer, "byte")
        for b in batches:
            doc, copy, piece, start, length, crc = [], [], [], [], [], []
            for d, c, ids in zip(b["doc_id"].to_pylist(), b["copy"].to_pylist(), enc.encode([t or "" for t in b["text"].to_pylist()]), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                n, at, k = len(ids), 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if k == 0 else capacity
                    doc.append(d), copy.append(c), piece.append(k), start.append(at), length.append(size)
                    crc.append(zlib.crc32(ids[at : at + size]))
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(copy, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "copy", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("copy"), "text")
    return rows.mapInArrow(run, PIECES)


def orders(lengths, capacity: int) -> list:
    """The orders to try: descending, and shuffled (always alike) above capacity / 8 with the rest descending."""
    import numpy as np

    down = np.argsort(-lengths, kind="stable")
    large = int((lengths * 8 > capacity).sum())
    return [down, np.concatenate([np.random.default_rng(len(lengths)).permutation(down[:large]), down[large:]])]


def pack_lengths(lengths, capacity: int):
    """Bin number and offset of each length (0 < length <= capacity), by the better of two orders."""
    import numpy as np

    lengths = np.asarray(lengths, np.int64)
    return min((pack_in_order(lengths, order, capacity) for order in orders(lengths, capacity)), key=lambda found: found[0].max(initial=-1))


def pack_in_order(lengths, order, capacity: int):
    """Bin number and offset of each length, taken in order, by the sum of squares."""
    import numpy as np

    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bins = 0
    for i in order:
        size = int(lengths[i])
        if size == capacity:
            number[i], offset[i] = bins, 0
            bins += 1
            continue
        there = size + np.flatnonzero(count[size:])
        best, gap = 2 * int(count[capacity - size]) + 1, capacity
        if len(there):
            left = there - size
            change = 2 * (count[left] - count[there]) + 2
            change[left == 0] = 1 - 2 * int(count[size])
            k = int(np.argmin(change))
            if change[k] <= best:
                gap = int(there[k])
        if gap == capacity:
            chosen, bins = bins, bins + 1
        else:
            chosen = open_bins[gap].pop()
            count[gap] -= 1
        number[i], offset[i] = chosen, capacity - gap
        if gap > size:
            open_bins[gap - size].append(chosen)
            count[gap - size] += 1
    return number, offset


def pack(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = materialize(pieces_of(docs, tokenizer, capacity, end_id), "pieces")
    groups = max(1, -(-pieces.where(F.col("length") < capacity).count() // group_pieces))
    full = pieces.where(F.col("length") >= capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa

        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).sort_by([(c, "ascending") for c in ("group", "doc_id", "piece", "ids_crc32")])
        group = rows["group"].to_numpy()
        seq, off = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            number, offset = pack_lengths(rows["length"].to_numpy()[own], capacity)
            seq[own], off[own] = (np.int64(g) << np.int64(32)) + number, offset
        out = rows.drop_columns(["group"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))
        yield from out.to_batches(max_chunksize=10_000)

    some = pieces.where(F.col("length") < capacity).withColumn("group", F.pmod(F.xxhash64("copy", "doc_id", "piece"), F.lit(groups)))
    packed = (
        some.repartition(groups, "group")
        .select("group", "doc_id", "piece", "start", "length", "ids_crc32")
        .mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )
    return packed.unionByName(full)
