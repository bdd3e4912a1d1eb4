"""Text to ids as the tokenizers library gives them, unit by unit through a bounded cache.

Texts are cut into units (see `pretokens`) at places where a token boundary is certain, so that the ids of a text are the ids
of its units one after another. Each distinct unit of a batch is looked up once; units that the cache doesn't hold get their
ids from the library: those that are just one pre-token from its model alone, others through its whole chain. The ids of all
texts of a batch are then put together by one numpy gather. This is some times as fast as encoding whole texts, whose words
mostly repeat. Texts that hold a special token, or (in `byte` vocabularies) white space outside ASCII, where units are not sure,
are encoded whole by the library.
"""

from __future__ import annotations

import re
from array import array

from .bpe_segment import byte_signs
from .pretokens import buffers, distinct, odd_space

#: Units held by one generation of the cache (two are held, each of about 50 MB); when one is full, the older goes.
CACHE_UNITS = 250_000
#: Longer units are not held.
CACHE_BYTES = 64

#: The sign of each byte, by its number: what byte-level vocabularies write for it.
_SIGNS = dict(enumerate(byte_signs()))
#: Units of a plain chunk that are one pre-token of a `byte` vocabulary.
_SINGLE = re.compile(rb" ?[^\x20\x09-\x0D]+")
_encoders: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Ids (arrays of uint32) of whole texts."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = kind
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[bytes], odd: list[bool]) -> dict[bytes, bytes]:
        """Ids of units, as bytes; odd: of a chunk that is not plain."""
        out, rest = {}, []
        tokenize, byte = self.model.tokenize, self.kind == "byte"
        for u, o in zip(units, odd, strict=True):
            if o or byte and not _SINGLE.fullmatch(u):
                rest.append(u)
            else:
                out[u] = array("I", [t.id for t in tokenize(u.decode("latin-1").translate(_SIGNS))]).tobytes()
        out.update(zip(rest, self._library([u.decode() for u in rest]), strict=True))
        return out

    def _ids(self, units: list[bytes], odd) -> list[bytes]:
        """Ids of distinct units."""
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
        learnt = self._learn(fresh, strange)
        cache.update(learnt)
        out = list(map(cache.__getitem__, units))
        for u in learnt:
            if len(u) > CACHE_BYTES:
                del cache[u]
        return out

    def encode(self, texts: list[str]) -> list:
        import numpy as np

        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.specials)}
        parts: list[list] = [[] for _ in texts]
        for numbers, held in buffers([b"" if i in whole else t.encode() for i, t in enumerate(texts)]):
            found = distinct(held, self.kind)
            if found is None:
                whole.update(numbers)
                continue
            units, odd, place, bounds = found
            if self.kind == "byte" and odd.any():
                unsure = np.array([o and odd_space(u) for u, o in zip(units, odd.tolist(), strict=True)])
                whole.update(numbers[k] for k in set((np.searchsorted(bounds, np.flatnonzero(unsure[place]), "right") - 1).tolist()))
            ids = self._ids(units, odd)
            flat = np.frombuffer(b"".join(ids), "<u4")
            counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            at = np.cumsum(counts) - counts
            n = counts[place]
            ends = np.cumsum(n)
            reached = np.concatenate([[0], ends])
            tokens = flat[np.repeat(at[place] - ends + n, n) + np.arange(reached[-1])]
            for k, i in enumerate(numbers):
                parts[i].append(tokens[reached[bounds[k]] : reached[bounds[k + 1]]])
        for i, ids in zip(sorted(whole), self._library([texts[i] for i in sorted(whole)]), strict=True):
            parts[i] = [np.frombuffer(ids, "<u4")]
        return [p[0] if len(p) == 1 else np.concatenate(p) for p in parts]


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder for a vocabulary file: it lives as long as the Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
