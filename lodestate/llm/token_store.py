"""Token ids on disk: documents compressed one by one with a shared zstandard dictionary, in shards with an offset index.

A shard (see `write_shard`) is: magic, SHA-256 of the dictionary, bytes per id, number of documents, then the index
(doc ids, token counts, frame offsets) and the frames. A reader finds a document by its place in the index and
decompresses that frame alone. The dictionary is trained on the serialised ids of at most SAMPLE_DOCS whole documents, those
of the smallest row hash in the whole table (equal rows count once): a documented bound for the training only.

Shards travel as the binary column of a Parquet table in the shared folder, so that any file system Spark reaches will do.
Documents are encoded and compressed where they lie; only the frames shuffle, into ranges of ascending doc_id. A task
writes a shard as soon as it holds `shard_bytes`, so its memory is bounded.

Defined cases: null text counts as empty (its ids are the end id alone); rows that repeat a doc_id stand next to each other;
a null doc_id comes first; an empty table gives no shards; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, materialize, tune

END_ID = 2
SAMPLE_DOCS = 1000
DICTIONARY_BYTES = 32_768
SHARD_BYTES = 4 << 20
LEVEL = 3

MAGIC = b"LSTOKEN1"
_HEAD = struct.Struct("<8s32sBQ")


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; where the samples are too few to train one, their first bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size].ljust(8, b"\0")


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data)


def write_shard(docs: list[tuple[int | None, int, bytes]], dictionary_hash: bytes, width: int) -> bytes:
    """docs: doc_id, number of ids, frame. A null doc_id is stored as the smallest integer."""
    n, offsets = len(docs), [0]
    for _, _, frame in docs:
        offsets.append(offsets[-1] + len(frame))
    ids = [-(1 << 63) if d is None else d for d, _, _ in docs]
    index = struct.pack(f"<{n}q{n}Q{n + 1}Q", *ids, *(c for _, c, _ in docs), *offsets)
    return _HEAD.pack(MAGIC, dictionary_hash, width, n) + index + b"".join(f for _, _, f in docs)


class Shard:
    """Random access to a shard: `self[i]` are the ids of its i-th document."""

    def __init__(self, blob: bytes, dictionary: bytes):
        import zstandard

        magic, found, self.width, n = _HEAD.unpack_from(blob)
        if magic != MAGIC or found != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard of this dictionary")
        index = struct.unpack_from(f"<{n}q{n}Q{n + 1}Q", blob, _HEAD.size)
        self.doc_ids, self.counts, self.offsets = index[:n], index[n : 2 * n], index[2 * n :]
        self.blob, self.base = blob, _HEAD.size + 8 * (3 * n + 1)
        self.reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, i: int):
        import numpy as np

        frame = self.blob[self.base + self.offsets[i] : self.base + self.offsets[i + 1]]
        size = self.counts[i] * self.width
        return np.frombuffer(self.reader.decompress(frame, max_output_size=size), f"<u{self.width}").astype("<u4")


def write(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = END_ID, width: int = 2) -> tuple[DataFrame, bytes]:
    """Write docs as shards; gives the table of shards (part, seq, docs, tokens, blob) and the dictionary.
    width: bytes per stored id, 2 for vocabularies of at most 65,536 ids."""
    spark = docs.sparkSession
    tune(spark)

    def narrow(ids) -> bytes:
        return ids.astype(f"<u{width}").tobytes()

    def ended(enc, texts: list[str]) -> list:
        import numpy as np

        return [np.append(x, np.uint32(end_id)) for x in enc.encode(texts)]

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def sample(batches):
        import pyarrow as pa

        from .token_cache import encoder

        enc = encoder(tokenizer, kind)
        for b in batches:
            ids = [narrow(x) for x in ended(enc, b["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    some = bounded_sample(rows, SAMPLE_DOCS).select("text")
    dictionary = train_dictionary(sorted(bytes(r["ids"]) for r in some.mapInArrow(sample, "ids binary").collect()))
    mark = hashlib.sha256(dictionary).digest()

    def frames(batches):
        import pyarrow as pa
        import zstandard

        from .token_cache import encoder

        enc = encoder(tokenizer, kind)
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_content_size=True)
        for b in batches:
            ids = ended(enc, b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([len(x) for x in ids], pa.int64()), pa.array([writer.compress(narrow(x)) for x in ids], pa.binary())],
                names=["doc_id", "n", "frame"],
            )

    framed = materialize(rows.mapInArrow(frames, "doc_id long, n long, frame binary"), "frames", "uncompressed")

    def shards(batches):
        import pyarrow as pa

        held, size, seq, part = [], 0, 0, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([sum(c for _, c, _ in held)], pa.int64()), pa.array([write_shard(held, mark, width)], pa.binary())],
                names=["part", "seq", "docs", "tokens", "blob"],
            )

        for b in batches:
            for d, n, f, part in zip(*(b[c].to_pylist() for c in ("doc_id", "n", "frame", "part")), strict=True):  # noqa: B020
                held.append((d, n, f))
                size += len(f) + 24
                if size >= SHARD_BYTES:
                    yield row()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield row()

    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = framed.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id())
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first()).select("doc_id", "n", "frame", "part")
    return materialize(dealt.mapInArrow(shards, "part int, seq long, docs long, tokens long, blob binary"), "shards", "uncompressed"), dictionary


def read(shards: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the shards."""
    totals = shards.groupBy("part").agg(F.sum("tokens").alias("total"))  # a row for each range, so one window over all is small
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "seq", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("inner")).join(totals, "part")
    starts = starts.select("part", "seq", (F.col("base") + F.col("inner")).alias("first"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for first, blob in zip(b["first"].to_pylist(), b["blob"].to_pylist(), strict=True):
                shard = Shard(blob, dictionary)
                starts = first + np.cumsum([0, *shard.counts])[:-1]
                crc = [zlib.crc32(shard[i].tobytes()) for i in range(len(shard))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if d == -(1 << 63) else d for d in shard.doc_ids], pa.int64()), pa.array(starts, pa.int64()), pa.array(shard.counts, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    found = shards.select("part", "seq", "blob").join(starts, ["part", "seq"]).select("first", "blob")
    return found.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
