"""Vectorised word splitting and 64-bit hashing over many texts at once (numpy, bounded buffers)."""

from __future__ import annotations

import numpy as np

#: Texts are hashed in buffers of about so many bytes; a longer text is cut at white space.
BUFFER_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the public splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64; one table for each worker."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BUFFER_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words `[^\\x20\\x09-\\x0D]+` of data."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hash_words(data: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of data: a polynomial over its bytes, taken from prefix sums, then scrambled."""
    raw = np.frombuffer(data, np.uint8)
    start, end = word_spans(data)
    if not len(start):
        return np.empty(0, np.uint64), start
    up, down = power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(((_LOWER[raw] if lower else raw).astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start]), start


def _pieces(data: bytes):
    """Cut a long text into buffers at white space; one giant word stays whole."""
    at = 0
    while len(data) - at > BUFFER_BYTES:
        cut = data.rfind(b" ", at, at + BUFFER_BYTES)
        cut = cut if cut > at else data.find(b" ", at + BUFFER_BYTES)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:] if at else data


def hash_texts(texts: list[bytes], lower: bool = False):
    """Yield, text by text, the uint64 hashes of its words. Short texts share one buffer; equal words have equal hashes."""
    group: list[bytes] = []
    size = 0

    def flush():
        data = b" ".join(group) + b" "
        h, start = _hash_words(data, lower)
        ends = np.cumsum([len(x) + 1 for x in group])
        cuts = np.searchsorted(start, ends)
        at = 0
        for c in cuts:
            yield h[at:c]
            at = c

    for t in texts:
        if len(t) > BUFFER_BYTES:
            if group:
                yield from flush()
                group, size = [], 0
            yield np.concatenate([_hash_words(p, lower)[0] for p in _pieces(t)])
            continue
        if size + len(t) > BUFFER_BYTES and group:
            yield from flush()
            group, size = [], 0
        group.append(t)
        size += len(t) + 1
    if group:
        yield from flush()


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words (k >= 1); empty when there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h = h * _BASE + words[j : j + n]
    return mix(h)
