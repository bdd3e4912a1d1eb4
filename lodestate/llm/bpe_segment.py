"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of a word's tree hold, for each symbol, the merge rank of the pair that starts there, together with its place;
inner nodes hold the minimum of their children, so the root yields the leftmost pair of lowest rank. A merge changes at
most three leaves, each updated up to the root in logarithmic time, until the root holds no mergeable pair. All words of a
batch run through their trees together in numpy, grouped by the power of two that holds their length.

Texts are cut into units at certain token boundaries (see `pretokens`), each distinct unit once a batch. Units of plain chunks are
the vocabulary's words already; others go through the vocabulary's own normaliser and split pattern, as its file states them. The
ids of frequent units are kept in a bounded cache of the worker.

Defined cases: null text counts as empty and has no ids; special tokens written in a text get their own ids, as in the
tokenizers library; repeated rows repeat their result; a word of any length is encoded whole; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, tune
from .pretokens import buffers, distinct

#: Units held by one generation of the cache; when one is full, the older goes.
CACHE_UNITS = 250_000
CACHE_BYTES = 64
#: Cells of the trees that are worked on at once.
TREE_CELLS = 1 << 20

# Fixed value: the end mark of the word vocabulary.
WORD_END = "</w>"


def byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies use for each byte: itself where printable, else from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    signs, spare = [], 256
    for b in range(256):
        signs.append(chr(b if b in plain else spare))
        spare += b not in plain
    return signs


class SegmentTreeBPE:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.signs = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        self.inside = np.array([vocab[s] for s in byte_signs()], np.int64)
        self.last = np.array([vocab[s + WORD_END] for s in byte_signs()], np.int64)
        self.base = len(self.signs)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        first, index = np.unique(keys, return_index=True)
        self.keys, self.ranks, self.made = first, index, made
        self.none = len(pairs)
        self.tokenizer = Tokenizer.from_file(path)
        self.byte = {s: b for b, s in enumerate(byte_signs())}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.cache: dict[bytes, list[int]] = {}
        self.older: dict[bytes, list[int]] = {}

    def _rank(self, left, right):
        """Merge rank of each pair, or `none`; a negative symbol has no pair."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], self.none)

    def _merge(self, words: list[bytes], width: int) -> list[list[int]]:
        """Ids of words of at most `width` bytes, a power of two."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        row, end = np.repeat(np.arange(n), size), np.cumsum(size)
        col = np.arange(len(data)) - np.repeat(end - size, size)
        symbol = np.full((n, width + 1), -1, np.int64)
        symbol[row, col] = self.inside[data]
        symbol[np.arange(n), size - 1] = self.last[data[end - 1]]
        place = np.arange(width)
        after = np.tile(np.minimum(np.arange(1, width + 2), width), (n, 1))
        before = np.tile(np.maximum(np.arange(-1, width), -1), (n, 1))
        never = self.none * width
        tree = np.empty((n, 2 * width), np.int64)
        rank = self._rank(symbol[:, :width], symbol[:, 1 : width + 1])
        tree[:, width:] = np.where(rank < self.none, rank * width + place, never)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        if width == 1:
            tree[:, 1] = never
        made_by_rank = self.made

        def put(rows, leaf, value):
            node = leaf + width
            tree[rows, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        live = np.flatnonzero(tree[:, 1] < never)
        while len(live):
            root = tree[live, 1]
            i = root % width
            j = after[live, i]
            symbol[live, i] = made_by_rank[root // width]
            k = after[live, j]
            after[live, i], before[live, k] = k, i
            symbol[live, j] = -1
            put(live, j, never)
            h = before[live, i]
            for left, right in ((i, k), (h, i)):
                rows, left, right = (live, left, right) if right is k else (live[left >= 0], left[left >= 0], right[left >= 0])
                if len(rows):
                    r = self._rank(symbol[rows, left], symbol[rows, right])
                    put(rows, left, np.where(r < self.none, r * width + left, never))
            live = live[tree[live, 1] < never]
        keep = symbol[:, :width] >= 0
        ids, ends = symbol[:, :width][keep].tolist(), np.cumsum(keep.sum(axis=1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w:
                by.setdefault(1 << (len(w) - 1).bit_length(), []).append(i)
        for width, which in by.items():
            step = max(1, TREE_CELLS // (8 * width))
            for a in range(0, len(which), step):
                part = which[a : a + step]
                for i, ids in zip(part, self._merge([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _words(self, unit: bytes) -> list[bytes]:
        """The words of a unit whose chunk is not plain, as UTF-8, by the vocabulary's normaliser and split pattern."""
        text = self.tokenizer.normalizer.normalize_str(unit.decode())
        return [bytes(self.byte[s] for s in w) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, units: list[bytes], odd: list[bool]) -> dict[bytes, list[int]]:
        """Ids of units; odd: of a chunk that is not plain."""
        split = [self._words(u) if o else [u] for u, o in zip(units, odd, strict=True)]
        words = list({w for p in split for w in p})
        known = dict(zip(words, self.encode_words(words), strict=True))
        return {u: known[p[0]] if len(p) == 1 else [i for w in p for i in known[w]] for u, p in zip(units, split, strict=True)}

    def ids(self, units: list[bytes], odd) -> list[list[int]]:
        """Ids of distinct units, from the cache or learnt now; long units are not kept."""
        if len(self.cache) > CACHE_UNITS:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        fresh, strange = [], []
        for i, u in enumerate(units):
            if u not in cache:
                if u in older:
                    cache[u] = older[u]
                else:
                    fresh.append(u), strange.append(odd[i])
        cache.update(self.learn(fresh, strange))
        out = list(map(cache.__getitem__, units))
        for u in fresh:
            if len(u) > CACHE_BYTES:
                del cache[u]
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder of its own: the tokens are joined by spaces."""
        return " ".join(map(self.signs.__getitem__, ids))

    def units(self, texts: list[str]):
        """For groups of pieces of texts: the number of each piece's text, the ids of the distinct units, the unit at each place and
        where each piece starts. A text's pieces come in its order: special tokens, which stand as they are, and what lies between."""
        pieces: list[tuple[int, bytes]] = []
        for i, t in enumerate(texts):
            pieces += [(i, p.encode()) for p in (self.cut.split(t) if "<|" in t else (t,))]
        special = {s.encode(): [v] for s, v in self.special.items()}
        for numbers, held in buffers([b"" if p in special else p for _, p in pieces]):
            owners, whole = [pieces[k][0] for k in numbers], [special.get(pieces[k][1]) for k in numbers]
            found = distinct(held, "word")
            if found is None:  # a hash collision: chunk by chunk
                chunks = [h.split() for h in held]
                names = {c: j for j, c in enumerate({c for p in chunks for c in p})}
                found = list(names), np.ones(len(names), bool), np.array([names[c] for p in chunks for c in p], np.int64), np.cumsum([0, *map(len, chunks)])
            units, odd, place, bounds = found
            yield owners, whole, self.ids(units, odd), place, bounds

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        for owners, whole, ids, place, bounds in self.units(texts):
            for k, i in enumerate(owners):
                out[i] += whole[k] or [v for j in place[bounds[k] : bounds[k + 1]].tolist() for v in ids[j]]
        return out

    def printed(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """For each text the number of its ids, the ids as decimals and the text decoded from them, joined by spaces."""
        parts: list[tuple[list[int], list[bytes], list[bytes]]] = [([], [], []) for _ in texts]
        for owners, whole, ids, place, bounds in self.units(texts):
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            decimal, text = np.empty(len(ids), object), np.empty(len(ids), object)
            decimal[:] = [" ".join(map(str, v)).encode() for v in ids]
            text[:] = [self.decode(v).encode() for v in ids]
            for k, i in enumerate(owners):
                n, dec, dec_text = parts[i]
                if whole[k]:
                    n.append(1), dec.append(b"%d" % whole[k][0]), dec_text.append(self.decode(whole[k]).encode())
                    continue
                own = place[bounds[k] : bounds[k + 1]]
                own = own[counts[own] > 0]
                if len(own):
                    n.append(int(counts[own].sum())), dec.append(b" ".join(decimal[own])), dec_text.append(b" ".join(text[own]))
        return [(sum(n), b" ".join(dec), b" ".join(text)) for n, dec, text in parts]


_models: dict[str, SegmentTreeBPE] = {}


def model(path: str) -> SegmentTreeBPE:
    """The worker's model of a vocabulary file; it lives as long as the Python worker."""
    if path not in _models:
        _models[path] = SegmentTreeBPE(path)
    return _models[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""
    tune(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        bpe = model(tokenizer)
        for b in batches:
            ids = bpe.encode(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text, decoded from the ids."""
    tune(encoded.sparkSession)

    def run(batches):
        import pyarrow as pa

        bpe = model(tokenizer)
        for b in batches:
            text = [bpe.decode(v or []) for v in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: every text encoded, then decoded from the ids, unit by unit."""
    tune(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        bpe = model(tokenizer)
        for b in batches:
            found = bpe.printed(b["text"].to_pylist())
            n, ids_sha, text_sha = [f[0] for f in found], [hashlib.sha256(f[1]).hexdigest() for f in found], [hashlib.sha256(f[2]).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
