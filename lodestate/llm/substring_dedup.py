"""Substring dedup with suffix automata: every word covered by a window of WINDOW words that also starts earlier goes.

The corpus is its own reference, so the reference is cut into shards that keep every possible match inside one shard. Each
window belongs to its minimizer, the smallest hash among its ANCHOR_WORDS-word runs: equal windows have equal minimizers.
Consecutive windows with the same minimizer occurrence form a segment (their text is a few dozen words). Then

1. documents yield their segments as (minimizer, doc, first and last window), without text; a minimizer that occurs once in the
   corpus cannot have a repeated window, so only segments of repeated minimizers go on, with their texts;
2. the segments of one minimizer are a shard: in the order of (doc, position) each segment streams through the shard's suffix
   automaton, whose matching statistics say where its last WINDOW words occur earlier, and is then added to the automaton
   with the segment's new windows. Windows found are repeated ones.

The named method broadcasts automata of reference shards. Here the reference is the whole corpus, whose size no bound holds, so
instead of sending every automaton to every document, segments go to the one shard that can match them. A minimizer with more than
HOT_SEGMENTS segments is split further: its windows become segments of their own, dealt by the hash of the whole window, and
each task sends on only its first of equal ones and answers for the rest itself. No automaton then exceeds HOT_SEGMENTS segments.

Defined cases: null or empty text has no words; fewer words than a window: nothing is removed; matches inside one document count
(the later start goes); rows that repeat a doc_id or have none count as one document each, ordered by (doc_id, text), nulls last; an
empty table gives an empty result; `substring_dedup` keeps all other columns of the input, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialize, tune
from .textops import hash_texts, mix, rolling

WINDOW = 20
ANCHOR_WORDS = 4
HOT_SEGMENTS = 1000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class SuffixAutomaton:
    """Of several word sequences; every state knows where its words end first: (doc, position)."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        last = 0
        nxt, link, length = self.next, self.link, self.length
        for w in words:
            to = nxt[last].get(w)
            if to is not None:  # a sequence added before has this prefix
                if length[to] == length[last] + 1:
                    last = to
                else:
                    last = self._clone(last, to, w)
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[new] = q if length[p] + 1 == length[q] else self._clone(p, q, w)
            last = new

    def _clone(self, p: int, q: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def statistics(self, words: list[bytes]) -> list[int]:
        """For each place the length of the longest run of words that ends there and occurs in the automaton."""
        out, state, size = [], 0, 0
        nxt, link, length = self.next, self.link, self.length
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                size += 1
            out.append(size)
        return out


def segments(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first and last window of each segment of a document, from its word hashes; and whether the minimizer
    occurs more than once in the document, so that one segment may hold equal windows."""
    anchors = rolling(hashes, ANCHOR_WORDS)
    span = window - ANCHOR_WORDS + 1
    n = len(anchors) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    low = _sliding(np.minimum, anchors, span)
    first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    key = low[first]
    edge = np.zeros(span - 1, np.uint64)
    minimal = anchors[anchors == _sliding(np.maximum, np.concatenate([edge, low, edge]), span)]
    twice = np.zeros(len(key), bool)
    if len(minimal) != len(key):
        values, counts = np.unique(minimal, return_counts=True)
        twice = counts[np.searchsorted(values, key)] > 1
    return key, first, np.concatenate([first[1:] - 1, [n - 1]]), twice


def _sliding(extreme, x: np.ndarray, span: int) -> np.ndarray:
    """The extreme of each run of `span` values: runs of doubling width, the last two overlapping."""
    width = 1
    while 2 * width <= span:
        x = extreme(x[:-width], x[width:])
        width *= 2
    return extreme(x[: len(x) - (span - width)], x[span - width :]) if width < span else x


def _occurrences(texts: DataFrame, window: int) -> DataFrame:
    """key, doc, first, last, twice of every segment."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            parts = [segments(h, window) for h in hash_texts([t.encode() for t in b["text"].to_pylist()])]
            docs = np.repeat(b["doc"].to_numpy(zero_copy_only=False), [len(p[0]) for p in parts])
            key, first, last, twice = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0),) * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.astype(np.uint64).view(np.int64)), pa.array(docs.astype(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(twice.astype(bool))],
                names=["key", "doc", "first", "last", "twice"],
            )

    return texts.mapInArrow(run, "key long, doc long, first int, last int, twice boolean")


SEGMENT = "key long, doc long, first int, words binary, found int"


def _runs(at: list[int]) -> list[tuple[int, int]]:
    """Ascending numbers as (first, count) of consecutive ones."""
    out: list[tuple[int, int]] = []
    for i in at:
        if out and sum(out[-1]) == i:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((i, 1))
    return out


def _with_texts(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of the wanted segments. Hot ones become single windows; of equal windows in a batch only the first goes on, the
    others come out as found: `found` of them from `first` on."""
    rows = rows.join(wanted, "_doc").select(*rows.columns, "wanted")  # all columns, so that the final join reuses this exchange

    def run(batches):
        import pyarrow as pa

        for b in batches:
            key, doc, first, text, found = [], [], [], [], []
            seen: set[bytes] = set()
            for d, t, wanted in sorted(zip(*(b[c].to_pylist() for c in ("_doc", "text", "wanted")), strict=True), key=lambda r: r[0]):
                words = _WORD.findall((t or "").encode())
                for s in sorted(wanted, key=lambda s: s["first"]):
                    if not s["hot"]:
                        key.append(s["key"]), doc.append(d), first.append(s["first"]), found.append(0)
                        text.append(b" ".join(words[s["first"] : s["last"] + window]))
                        continue
                    again = []
                    for at in range(s["first"], s["last"] + 1):
                        own = b" ".join(words[at : at + window])
                        if own in seen:
                            again.append(at)
                            continue
                        seen.add(own)
                        key.append(int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True))
                        doc.append(d), first.append(at), text.append(own), found.append(0)
                    for at, n in _runs(again):
                        key.append(d), doc.append(d), first.append(at), text.append(b""), found.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(first, pa.int32()), pa.array(text, pa.binary()), pa.array(found, pa.int32())],
                names=["key", "doc", "first", "words", "found"],
            )

    return rows.mapInArrow(run, SEGMENT)


def _match(shards: DataFrame, window: int) -> DataFrame:
    """doc, first and number of repeated windows; shards: segments grouped by key, in order of (doc, first)."""

    def run(batches):
        import pyarrow as pa

        key, automaton, alone, known = None, None, None, set()
        for b in batches:
            docs, firsts, counts = [], [], []
            for k, d, first, text, found in zip(*(b[c].to_pylist() for c in ("key", "doc", "first", "words", "found")), strict=True):
                n = found or text.count(b" ") + 2 - window
                if k != key:
                    key, automaton, alone, known = k, None, None, set()
                if found or text in known:
                    docs.append(d), firsts.append(first), counts.append(n)
                    continue
                known.add(text)
                new, hits = text.split(b" "), set()
                if alone:  # an automaton is built only when a shard has a second, different segment
                    automaton = SuffixAutomaton()
                    automaton.add(alone)
                    alone = None
                if automaton:
                    hits = {i for i, size in enumerate(automaton.statistics(new)[window - 1 :]) if size >= window}
                if n > 1 and len(set(new)) < len(new):  # a window may also repeat inside its own segment
                    mine: dict[tuple, int] = {}
                    hits |= {i for i in range(n) if mine.setdefault(tuple(new[i : i + window]), i) != i}
                for i, size in _runs(sorted(hits)):
                    docs.append(d), firsts.append(first + i), counts.append(size)
                if automaton is None:
                    alone = new
                elif len(hits) < n:
                    automaton.add(new)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(firsts, pa.int32()), pa.array(counts, pa.int32())], names=["doc", "first", "n"])

    return shards.mapInArrow(run, "doc long, first int, n int")


def repeated_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, first, n): the windows of rows (`_doc`, which ascends in the order of precedence, text) that also start earlier."""
    tune(rows.sparkSession)
    texts = rows.select(F.col("_doc").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    all_of = materialize(_occurrences(texts, window), "segments")
    often = all_of.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("inside")).where("n > 1 or inside")
    some = all_of.join(often, "key").select("doc", "key", "first", "last", (F.col("n") > HOT_SEGMENTS).alias("hot"))
    wanted = some.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("key", "first", "last", "hot")).alias("wanted"))
    shards = _with_texts(rows, wanted, window).repartition("key").sortWithinPartitions("key", "doc", "first")
    return _match(shards, window)


def removals(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """rows (of `keyed`) with `_at`: runs (first, n) of the document's repeated windows, null without any."""
    gone = repeated_windows(rows, window).groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("first", "n")).alias("_at"))
    return rows.join(gone, "_doc", "left")


def _kept(words: list[bytes], runs: list[dict] | None, window: int) -> np.ndarray:
    """Which words stay."""
    edge = np.zeros(len(words) + 1, np.int64)
    if runs:
        np.add.at(edge, [r["first"] for r in runs], 1)
        np.add.at(edge, [r["first"] + r["n"] + window - 1 for r in runs], -1)
    return np.cumsum(edge)[:-1] == 0


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    rows = removals(keyed(docs.select(F.col("doc_id").cast("long"), "text"))[0], window)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n, removed, sha = [], [], []
            for t, at in zip(b["text"].to_pylist(), b["_at"].to_pylist(), strict=True):
                words = _WORD.findall((t or "").encode())
                left = list(compress(words, _kept(words, at, window).tolist())) if at else words
                n.append(len(words)), removed.append(len(words) - len(left)), sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.select("doc_id", "text", "_at").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all columns, with the repeated words taken out of `text` (other text stays byte for byte; a document that loses
    words has those left joined by one space; one that loses all of them goes). `n_chars`, if there, follows the text."""
    rows = removals(keyed(docs)[0], window)
    columns = [c for c in rows.columns if c not in ("_doc", "_at")]
    schema = rows.select(columns).schema

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = []
            for t, at in zip(b["text"].to_pylist(), b["_at"].to_pylist(), strict=True):
                if at:
                    words = _WORD.findall(t.encode())
                    t = b" ".join(compress(words, _kept(words, at, window).tolist())).decode()
                texts.append(t)
            gone = [bool(at) and not t for t, at in zip(texts, b["_at"].to_pylist(), strict=True)]
            cols = {c: b[c] for c in b.schema.names if c != "_at"}
            cols["text"] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([n if not at else len(t) for n, t, at in zip(b["n_chars"].to_pylist(), texts, b["_at"].to_pylist(), strict=True)], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols)).filter(pa.array([not g for g in gone], pa.bool_()))

    return rows.select(*columns, "_at").mapInArrow(run, schema).toDF(*docs.columns)
