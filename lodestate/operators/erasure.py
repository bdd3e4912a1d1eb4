"""Erasure coding: values in data fragments and parity fragments, any `data` of which give the value back.

Systematic Reed-Solomon over GF(256) (polynomial 0x11D) with a Cauchy matrix: fragment `data + i` is the sum of 1 / (x_i + y_j) times
data fragment j. Values are padded with zeros to equal fragments; their length travels with each fragment.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the generator (twice over) and logarithms."""
    power, log, x = np.zeros(510, np.uint8), np.zeros(256, np.int64), 1
    for i in range(255):
        power[i] = power[i + 255] = x
        log[x] = i
        x = (x << 1) ^ (0x11D if x & 0x80 else 0)
    return power, log


def multiply(scalar: int, row: np.ndarray) -> np.ndarray:
    power, log = _tables()
    if scalar == 0:
        return np.zeros_like(row)
    return np.where(row == 0, 0, power[log[row] + log[scalar]]).astype(np.uint8)


def _inverse(x: int) -> int:
    power, log = _tables()
    return int(power[255 - log[x]])


def matrix(data: int, parity: int) -> list[list[int]]:
    """One row for each fragment: the identity, then the Cauchy rows."""
    if not (data > 0 and parity >= 0 and data + parity <= 256):
        raise ValueError("1 to 256 fragments, one of data at least")
    own = [[int(i == j) for j in range(data)] for i in range(data)]
    return own + [[_inverse((data + i) ^ j) for j in range(data)] for i in range(parity)]


def fragments(value: bytes, data: int, parity: int) -> list[bytes]:
    size = max(1, -(-len(value) // data))
    rows = np.frombuffer(value.ljust(size * data, b"\0"), np.uint8).reshape(data, size)
    out = []
    for weights in matrix(data, parity):
        out.append(functools.reduce(np.bitwise_xor, (multiply(w, r) for w, r in zip(weights, rows, strict=True))).tobytes())
    return out


def value_of(held: dict[int, bytes], data: int, parity: int, size: int) -> bytes:
    """The value from any `data` of its fragments, by Gauss-Jordan elimination of their rows."""
    if len(held) < data:
        raise ValueError(f"{data} fragments are needed, {len(held)} are there")
    chosen = sorted(held)[:data]
    left = [list(matrix(data, parity)[i]) for i in chosen]
    right = [np.frombuffer(held[i], np.uint8) for i in chosen]
    for c in range(data):
        pivot = next(r for r in range(c, data) if left[r][c])
        left[c], left[pivot], right[c], right[pivot] = left[pivot], left[c], right[pivot], right[c]
        scale = _inverse(left[c][c])
        left[c], right[c] = multiply(scale, np.array(left[c], np.uint8)).tolist(), multiply(scale, right[c])
        for r in range(data):
            if r != c and left[r][c]:
                factor = left[r][c]
                left[r] = (np.array(left[r], np.uint8) ^ multiply(factor, np.array(left[c], np.uint8))).tolist()
                right[r] = right[r] ^ multiply(factor, right[c])
    return b"".join(r.tobytes() for r in right)[:size]


def encode(values: DataFrame, data: int, parity: int) -> DataFrame:
    """key, fragment, size (of the value), bytes of values (key, value)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(k, i, len(v), f) for k, v in zip(b["key"].to_pylist(), b["value"].to_pylist(), strict=True) for i, f in enumerate(fragments(v, data, parity))]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "fragment", "size", "bytes"])

    return values.select("key", "value").mapInArrow(run, "key long, fragment int, size long, bytes binary")


def decode(held: DataFrame, data: int, parity: int) -> DataFrame:
    """key, value of the fragments at hand; a value has data + parity of them at most, which bounds a row."""
    by = held.groupBy("key").agg(F.first("size").alias("size"), F.collect_list(F.struct("fragment", "bytes")).alias("held"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            values = [value_of({f["fragment"]: f["bytes"] for f in h}, data, parity, n) for n, h in zip(b["size"].to_pylist(), b["held"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(values, pa.binary())], names=["key", "value"])

    return by.select("key", "size", "held").mapInArrow(run, "key long, value binary")
