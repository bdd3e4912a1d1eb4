"""Audio columns: lossless 8-bit media, polyphase resampling, overlapped log-mel filterbanks, energy segments.

A payload is stored as the samples of a mono 8-bit WAV file (`wav`), written as a media column and read back (`samples`).
Features of one item: resampling by `UP`/`DOWN` with a windowed-sinc polyphase filter, frames of `FRAME` samples every `HOP`,
Hann window, power spectrum, `MELS` triangular mel bands, natural logarithm; then segments by hysteresis: one opens when a
frame's log energy rises above the high threshold and closes when it falls below the low one. The log-mel matrix is stored as a
fixed-shape Arrow tensor: windows of `TENSOR_FRAMES` frames (the last padded with the floor), each with its time span in ms. An
item's windows are one Arrow stream (`pack`), the binary column of a Parquet table in the shared folder, as Spark has no such type.

Each item is computed by itself in blocks of a fixed number of frames, so equal payloads give equal bits whatever their batch,
and memory stays bounded for very long items.

Defined cases: a null text counts as empty; an item shorter than a frame is padded to one; silence has no segments; repeated rows
are items of their own; an empty table gives an empty result; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of, tune

RATE = 16_000
UP, DOWN, TAPS = 3, 8, 16
FRAME, HOP, MELS = 256, 128, 24
TENSOR_FRAMES = 32
FLOOR = 1e-6
BLOCK_FRAMES, BLOCK_SAMPLES = 2048, 1 << 16
#: Payloads are padded with bytes 255 to a positive multiple of this.
UNIT = 576

_HEAD = struct.Struct("<4sI4s4sIHHIIHH4sI")


def wav(payload: bytes) -> bytes:
    """A mono, 8-bit PCM WAV file of the payload's bytes as samples (length even: UNIT is)."""
    n = len(payload)
    return _HEAD.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def samples(media: bytes) -> bytes:
    """The samples of such a file, found through its own header."""
    riff, _, wave, _, _, kind, channels, _, _, _, bits, _, n = _HEAD.unpack_from(media)
    if (riff, wave, kind, channels, bits) != (b"RIFF", b"WAVE", 1, 1, 8):
        raise ValueError("not a mono 8-bit WAV file")
    return media[_HEAD.size : _HEAD.size + n]


@functools.cache
def _filter() -> np.ndarray:
    """The polyphase branches of a Hann-windowed sinc low-pass: row p holds the taps of output phase p."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hanning(n + 2)[1:-1]
    return np.stack([(h * UP / h.sum())[p::UP] for p in range(UP)]).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """x at UP/DOWN of its rate: each output sample is the product of one branch with the TAPS inputs up to its place. Samples of one
    phase are DOWN inputs apart; they are made in blocks, so that only x and the result are held whole."""
    out = np.empty(-(-len(x) * UP // DOWN), np.float32)
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(TAPS - 1, np.float32), x]), TAPS)
    for k in range(UP):
        at, phase = divmod(k * DOWN, UP)
        target = out[k::UP]
        own, branch = rows[at::DOWN][: len(target)], _filter()[phase][::-1]
        for a in range(0, len(target), BLOCK_SAMPLES):
            target[a : a + BLOCK_SAMPLES] = own[a : a + BLOCK_SAMPLES] @ branch
    return out


@functools.cache
def _mel() -> np.ndarray:
    rate = RATE * UP / DOWN
    scale = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, scale(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


@functools.cache
def _window() -> np.ndarray:
    return np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    """frames x MELS, float32."""
    x = np.pad(x, (0, max(0, FRAME - len(x)))) if len(x) < FRAME else x
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = []
    for a in range(0, len(frames), BLOCK_FRAMES):
        spectrum = np.fft.rfft(frames[a : a + BLOCK_FRAMES] * _window())
        out.append(np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _mel() + FLOOR))
    return np.concatenate(out)


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans [start, end) by hysteresis on log energy: high and low thresholds lie around the item's own mean."""
    energy = np.log(np.exp(mel.astype(np.float64)).sum(axis=1))
    if energy.max() <= np.log(MELS * FLOOR * 2):
        return []
    high, low = energy.mean() + 0.25 * energy.std(), energy.mean() - 0.25 * energy.std()
    state = np.where(energy >= high, 1, np.where(energy < low, -1, 0))
    last = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = np.where(last >= 0, state[last] == 1, False).astype(np.int8)
    edge = np.diff(np.concatenate([[0], on, [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def features(payload: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x))
    return mel, segments(mel)


def span_ms(frame: int) -> int:
    return frame * HOP * 1000 * DOWN // (RATE * UP)


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a WAV file) of every whole text, written to the shared folder."""
    tune(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            raw = [t.encode() for t in b["text"].to_pylist()]
            media = [wav(r + b"\xff" * (max(1, -(-len(r) // UNIT)) * UNIT - len(r))) for r in raw]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")
    return materialize(rows, "media")


def frame_at(ms: int) -> int:
    """The frame whose span_ms is ms."""
    return -(-ms * RATE * UP // (HOP * 1000 * DOWN))


def pack(mel: np.ndarray) -> bytes:
    """An Arrow stream of the windows of a log-mel matrix: window, start_ms, end_ms and mel, a fixed-shape tensor."""
    import pyarrow as pa

    n = -(-len(mel) // TENSOR_FRAMES)
    full = np.full((n, TENSOR_FRAMES, MELS), np.log(FLOOR), np.float32)
    full.reshape(-1, MELS)[: len(mel)] = mel
    starts = [span_ms(k * TENSOR_FRAMES) for k in range(n)]
    ends = [span_ms(min(len(mel), (k + 1) * TENSOR_FRAMES)) for k in range(n)]
    cols = [pa.array(range(n), pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.FixedShapeTensorArray.from_numpy_ndarray(full)]
    windows = pa.RecordBatch.from_arrays(cols, names=["window", "start_ms", "end_ms", "mel"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, windows.schema) as stream:
        stream.write_batch(windows)
    return out.getvalue().to_pybytes()


def unpack(stored: bytes):
    """The windows of such a stream, a record batch."""
    import pyarrow as pa

    with pa.ipc.open_stream(stored) as stream:
        windows = stream.read_next_batch()
    if windows.schema.field("mel").type != pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS)):
        raise ValueError("not a log-mel tensor")
    return windows


def matrix(windows) -> np.ndarray:
    """The log-mel matrix of all windows, without the padding: the last span tells the number of frames."""
    frames = frame_at(windows.column("end_ms")[-1].as_py())
    return windows.column("mel").to_numpy_ndarray().reshape(-1, MELS)[:frames]


def tensor_table(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digests of the media as read back, and tensors (see `pack`) of every item, written to the shared folder."""
    tune(media.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for m in b["media"].to_pylist():
                p = samples(m)
                mel, _ = features(p)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), pack(mel)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tensors"]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors binary"
    return materialize(media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema), "tensors")


def windows(stored: DataFrame) -> DataFrame:
    """The stored tensors as Spark rows, one per window: doc_id, window, start_ms, end_ms, mel (TENSOR_FRAMES x MELS, row-major).
    Spark has no fixed-shape type, so here mel is a list; what is stored keeps its type."""
    tune(stored.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for d, t in zip(b["doc_id"].to_pylist(), b["tensors"].to_pylist(), strict=True):
                w = unpack(t)
                mel = w.column("mel").storage.cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(w), pa.int64()), *w.columns[:3], mel], names=["doc_id", "window", "start_ms", "end_ms", "mel"])

    return stored.select("doc_id", "tensors").mapInArrow(run, "doc_id long, window int, start_ms long, end_ms long, mel array<float>")


def tensors(media: DataFrame) -> DataFrame:
    """The windows of every item, stored and read back."""
    return windows(tensor_table(media))


def summary(mel: np.ndarray, spans: list[tuple[int, int]]) -> str:
    """Frames, segments and their total ms, and a digest of the tensor quantised to hundredths."""
    fine = hashlib.sha256(np.round(mel * 100).astype("<i4").tobytes()).hexdigest()[:16]
    return f"frames={len(mel)};segments={len(spans)};active_ms={sum(span_ms(b) - span_ms(a) for a, b in spans)};mel={fine}"


def digests(media: DataFrame) -> DataFrame:
    """What was stored, read back: payload and media digests and a summary of the features, derived from the stored tensors."""
    stored = tensor_table(media)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = []
            for t in b["tensors"].to_pylist():
                mel = matrix(unpack(t))
                found.append(summary(mel, segments(mel)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.string())], names=[*b.schema.names[:-1], "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(run, schema)
