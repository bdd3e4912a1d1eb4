"""Language identification: averaged hashed subword embeddings, a linear softmax over them, trained by SGD in numpy.

A text's subwords are its byte 3- and 4-grams (A-Z lower-cased), hashed into `BUCKETS` rows of an embedding table; their
average goes through a linear layer and a softmax. As both steps are linear, a prediction needs only the product of the two
matrices: one row of class scores for each bucket.

Calibration: on labelled texts kept out of the training, a temperature is chosen by log loss, and the rejection threshold
is the score below which `REJECT_SHARE` of the correctly predicted texts fall. With fewer than 1 / `REJECT_SHARE`
such texts that score is unknown and no score is rejected. `accepted` is false for scores below it and
for texts without a letter.

The model is fitted and calibrated on at most `SAMPLE_DOCS` labelled documents, those of the smallest row hash in the whole table
(equal rows count once): a documented bound of the training only. Their whole texts are read where they lie; only their buckets' shares come to the driver, 6 bytes
for each bucket that a text has, 200 kB a text at most. Predictions read every whole text.

Defined cases: null text or one without a letter (Unicode's L) is `und` with score 0; without a labelled row every text is `und`;
of equally likely classes the first by name is predicted; equal texts get equal results; a text of any length is summed block by
block, each subword once; an empty table gives an empty result; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, tune

BUCKETS = 1 << 15
DIMENSIONS = 16
SAMPLE_DOCS = 3000
EPOCHS = 6
BATCH = 32
LEARNING_RATE = 0.6
REJECT_SHARE = 0.01
#: A text is scored in blocks of so many bytes, so that memory stays bounded.
BLOCK_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = regex.compile(r"\p{L}")


def blocks(text: str):
    """The buckets of a text's subwords, block by block: the byte 3-grams that start in a block, then its 4-grams."""
    raw = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    for a in range(0, max(0, len(raw) - 2), BLOCK_BYTES):
        b = raw[a : a + BLOCK_BYTES + 3]
        three = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        four = (three[:-1] << np.uint32(8)) | b[3:]
        yield np.concatenate([(three[:BLOCK_BYTES] * np.uint32(2654435761)) >> shift, (four * np.uint32(2246822519)) >> shift])


class LanguageModel:
    def __init__(self, classes: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.classes, self.scores, self.bias, self.temperature, self.threshold = classes, scores, bias, temperature, threshold

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.classes or not _LETTER.search(text):
            return "und", 0.0, False
        total, n = np.zeros(len(self.classes)), 0
        for ids in blocks(text):
            total += self.scores[ids].sum(axis=0)
            n += len(ids)
        logits = (total / max(1, n) + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.classes[k], float(p[k]), bool(p[k] >= self.threshold)


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text's subwords, ascending, and how often each occurs."""
    count = np.zeros(BUCKETS, np.int64)
    for found in blocks(text):
        count += np.bincount(found, minlength=BUCKETS)
    ids = np.flatnonzero(count)
    return ids.astype(np.uint16), count[ids]


def shares(count: np.ndarray) -> np.ndarray:
    return (count / max(1, count.sum())).astype(np.float32)


def train(counts: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 7) -> LanguageModel:
    """Fit by stochastic gradient descent on four fifths of the texts (their `bucket_counts`, or float32 `shares` instead of the counts),
    calibrate on the rest."""
    classes = sorted(set(langs))
    empty = LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    if not classes:
        return empty
    rng = np.random.default_rng(seed)
    x = [(i, c if c.dtype == np.float32 else shares(c)) for i, c in counts]
    y = np.array([classes.index(v) for v in langs])
    order = rng.permutation(len(x))
    held = order[: len(x) // 5]
    fit = order[len(x) // 5 :]
    embed = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    scale = np.float32(BUCKETS**0.5)  # averages of thousands of subwords are small: the rate of the embeddings makes up for it
    for epoch in range(EPOCHS):
        rate = np.float32(LEARNING_RATE * (1 - epoch / EPOCHS))
        for at in range(0, len(fit), BATCH):
            part = fit[at : at + BATCH]
            mean = np.stack([w @ embed[i] for i, w in (x[j] for j in part)])
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            back = p @ layer.T
            layer -= rate * scale / 16 * mean.T @ p
            bias -= rate * p.sum(axis=0)
            for j, g in zip(part, back, strict=True):
                i, w = x[j]
                embed[i] -= rate * scale * w[:, None] * g
    scores = (embed @ layer).astype(np.float64)
    model = LanguageModel(classes, scores, bias.astype(np.float64), 1.0, 0.0)
    if not len(held):
        return model
    logits = np.stack([w @ scores[i] for i, w in (x[j] for j in held)]) + model.bias

    def soft(t: float) -> np.ndarray:
        e = np.exp((logits - logits.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    temperatures = np.geomspace(0.02, 20, 61)
    model.temperature = float(min(temperatures, key=lambda t: -np.log(soft(t)[np.arange(len(held)), y[held]] + 1e-12).mean()))
    p = soft(model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
    model.threshold = float(np.quantile(right, REJECT_SHARE)) if len(right) * REJECT_SHARE >= 1 else 0.0
    return model


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4: documents with remainder 2 are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Learn from labelled documents outside the held-out fold."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 2))
    tune(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [bucket_counts(t) for t in b["text"].to_pylist()]
            ids, n = pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([shares(f[1]).tobytes() for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["lang"], ids, n], names=["doc_id", "lang", "ids", "n"])

    rows = bounded_sample(usable.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text"), sample_docs)
    rows = rows.mapInArrow(run, "doc_id long, lang string, ids binary, n binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["ids"], r["n"], r["lang"]))
    return train([(np.frombuffer(r["ids"], np.uint16), np.frombuffer(r["n"], np.float32)) for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every document."""
    tune(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            lang, score, ok = zip(*(model.predict(t) for t in b["text"].to_pylist())) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["held_out"], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs, with all their columns, whose language the model accepts."""
    tune(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield b.filter(pa.array([model.predict(t)[2] for t in b["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
