"""The units of texts that a vocabulary encodes one by one, found for many texts at once in numpy, each distinct unit once.

A unit ends where a token boundary is certain, so that the ids of a text are the ids of its units one after another.
A chunk is a run of bytes other than ASCII white space. It is plain when it holds only printable ASCII but apostrophes, and the
Latin letters of U+00C0 to U+00FF; then its units are its runs of letters, of digits and of other signs:

* `word` vocabularies split and lower-case just so (each digit is a unit), and drop white space. A chunk that is not plain
  is one unit.
* `byte` vocabularies keep white space: the white space before a chunk belongs to its first unit (or to the whole chunk where
  it is not plain), and trailing white space of a text is a unit of its own. This does not hold for texts with white space
  outside ASCII; the caller recognises them by `odd_space` in their units.

Equal units are found by a 64-bit hash and then compared byte by byte, so a hash collision is noticed.
"""

from __future__ import annotations

import re

import numpy as np

from .textops import power

#: Texts share buffers of about so many bytes; a longer text is cut before white space.
BUFFER_BYTES = 1 << 20

_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[ord("'")] = _ODD
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LATIN = 0xC3  # the first byte of U+00C0 to U+00FF in UTF-8
#: Masks that keep the first n bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]")
_TAIL = re.compile(rb"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")


def odd_space(unit: bytes) -> bool:
    """Whether a unit holds white space, or what some take for it, outside ASCII's six."""
    return _ODD_SPACE.search(unit.decode()) is not None


def classes(raw: np.ndarray) -> np.ndarray:
    """The class of every byte; both bytes of a Latin letter beyond ASCII are a letter's."""
    kind = _CLASS[raw]
    lead = np.flatnonzero(raw[:-1] == _LATIN)
    if len(lead):
        lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]  # the signs of multiplication and division
        kind[lead] = kind[lead + 1] = _LETTER
    return kind


def lowered(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin letters of `classes`."""
    low = _LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == _LATIN) + 1
    if len(lead):
        second = raw[lead]
        low[lead] = np.where((second < 0x9F) & (second != 0x97), second + 32, second)
    return low


def spans(raw: np.ndarray, heads: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the units of texts that begin at `heads`, and whether each is of a chunk that is not plain."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    cls = classes(raw)
    head = np.zeros(n, bool)
    head[heads[heads < n]] = True
    space = cls == _SPACE
    before = np.concatenate([[True], space[:-1]]) | head
    chunk = np.flatnonzero(~space & before)
    edge = np.empty(n, bool)  # where a unit starts if its chunk is plain
    edge[0] = True
    np.not_equal(cls[1:], cls[:-1], out=edge[1:])
    if kind == "word":
        edge |= cls == _DIGIT
    odd = np.flatnonzero(cls == _ODD)
    odd_chunk = np.zeros(len(chunk), bool)
    if len(odd):
        odd_chunk[np.searchsorted(chunk, odd, "right") - 1] = True
        begin = chunk[odd_chunk]
        after = np.concatenate([chunk[1:], [n]])[odd_chunk]
        depth = np.zeros(n + 1, np.int8)
        depth[begin + 1] += 1
        depth[after] -= 1
        edge &= ~np.cumsum(depth[:-1], dtype=np.int8).view(bool) | space
    edge &= ~space
    edge[chunk] = True
    if kind == "word":
        start = np.flatnonzero(edge)
        stop = np.flatnonzero(~space & np.concatenate([edge[1:] | space[1:], [True]])) + 1
    else:
        gap = space & (np.concatenate([[True], ~space[:-1]]) | head)  # where white space starts
        # a chunk's first unit starts with the white space before it, unless the text starts in between
        edge = gap | edge & ~(np.concatenate([[False], space[:-1]]) & ~head)
        start = np.flatnonzero(edge)
        stop = np.concatenate([start[1:], [n]])
    which = np.searchsorted(chunk, stop - 1, "right") - 1
    return start, stop, odd_chunk[which] & ~space[stop - 1] if len(chunk) else np.zeros(len(start), bool)


def _same(raw: np.ndarray, start: np.ndarray, size: np.ndarray, twin: np.ndarray) -> bool:
    """Whether each unit equals the unit `twin` byte by byte. raw ends with eight spare bytes."""
    if not np.array_equal(size, size[twin]):
        return False
    words = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    rest, at = np.arange(len(start)), 0
    while len(rest):
        keep = _FIRST[np.minimum(size[rest] - at, 8)]
        if ((words[start[rest] + at] ^ words[start[twin[rest]] + at]) & keep).any():
            return False
        at += 8
        rest = rest[size[rest] > at]
    return True


def distinct(texts: list[bytes], kind: str):
    """The distinct units of texts (with `kind` word in lower case where their chunk is plain), whether their chunk is odd, the
    unit at each place, and the places where each text starts (and the last ends). None on a hash collision."""
    ends = np.cumsum([len(t) for t in texts])
    heads = np.concatenate([[0], ends])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    start, stop, odd = spans(raw, heads[:-1], kind)
    plain = np.concatenate([lowered(raw) if kind == "word" else raw, np.zeros(8, np.uint8)])
    if kind == "word" and odd.any():  # the normaliser decides about them
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[start[odd]] += 1
        inside[stop[odd]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        plain[:-8][inside] = raw[inside]
    up, down = power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((plain[:-8].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[stop] - sums[start]) * down[start]
    order = np.argsort(h)
    new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]]) if len(h) else np.empty(0, bool)
    first = order[new]
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    if not _same(plain, start, stop - start, first[place]):
        return None
    data = plain.tobytes()
    units = [data[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)]
    return units, odd[first], place, np.searchsorted(start, heads)


def buffers(texts: list[bytes]):
    """Texts in groups of about BUFFER_BYTES, as (numbers of texts, their bytes); a longer text comes alone, in pieces cut before
    white space (one giant chunk stays whole), each piece with the text's number."""
    group, held, size = [], [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > BUFFER_BYTES:
            yield group, held
            group, held, size = [], [], 0
        at = 0
        while len(t) - at > BUFFER_BYTES:
            cut = _TAIL.search(t, at + BUFFER_BYTES)
            if not cut:
                break
            yield [i], [t[at : cut.end()]]
            at = cut.end()
        group.append(i), held.append(t[at:] if at else t)
        size += len(held[-1])
    if held:
        yield group, held
