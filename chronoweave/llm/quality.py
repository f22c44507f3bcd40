"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Features are the words of a text, their shapes (classes of bytes) and the pairs of both, hashed to
``DIM`` slots; a slot's value is the square root of its share of the kind's n-grams. Training
runs on the driver over a bounded sample; scoring is one map over all texts, a sparse dot product
for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .labelled import MAX_BYTES, MAX_DOCUMENTS, fold, sample

BITS = 18
DIM = 1 << BITS
THRESHOLD = 0.7
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.1, 8


def features(part: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of all texts of a chunk, ordered by row and slot."""
    starts, ends, at = K.words(part, offs)
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    keys, weights = [], []
    for kind, h in enumerate((K.hash_words(part, starts, ends), K.hash_shapes(part, starts, ends))):
        n = np.maximum(np.diff(at), 1)
        with np.errstate(over="ignore"):
            one = K.mix(h ^ K.U64(2 * kind + 11))
            pair = K.mix(h[:-1] * K.U64(3) + K.mix(h[1:]) + K.U64(2 * kind + 12))
        inside = rows[:-1] == rows[1:]
        for h2, r2 in ((one, rows), (pair[inside], rows[:-1][inside])):
            keys.append((r2.astype(K.U64) << K.U64(BITS)) | (h2 >> K.U64(64 - BITS)))
            weights.append(1.0 / n[r2])
    key = np.concatenate(keys)
    unique, inverse = np.unique(key, return_inverse=True)
    share = np.bincount(inverse, np.concatenate(weights), minlength=len(unique))
    return (unique >> K.U64(BITS)).astype(np.int64), (unique & K.U64(DIM - 1)).astype(np.int64), np.sqrt(share)


def _rows(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = K.buffers(texts)
    for first, end, part, offs in K.chunks(data, offsets):
        row, slot, value = features(part, offs)
        cuts = np.searchsorted(row, np.arange(end - first + 1))
        yield from ((slot[a:z], value[a:z]) for a, z in zip(cuts[:-1], cuts[1:]))


def train(texts: pa.Array, labels: list[int], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (DIM and a bias) by FTRL-proximal; the same for the same rows. No rows give zeros."""
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    rows = [(np.append(slot, DIM), np.append(value, 1.0)) for slot, value in _rows(texts)]
    for epoch in range(epochs):
        for r in np.random.default_rng(epoch).permutation(len(rows)):
            i, x = rows[r]
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - labels[r]) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(DIM + 1)).astype(np.float32)


def scores(texts: pa.Array, model: np.ndarray) -> np.ndarray:
    data, offsets = K.buffers(texts)
    out = np.full(len(texts), float(model[DIM]))
    for first, end, part, offs in K.chunks(data, offsets):
        row, slot, value = features(part, offs)
        out[first:end] += np.bincount(row, value * model[slot], minlength=end - first)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """A model from labelled documents whose crc32(doc_id) mod 4 is not 2, within the two bounds."""
    return train(*sample(documents, labels, "quality", 4, 2, max_documents, max_bytes))


def quality(documents: DataFrame, model: np.ndarray) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= ``THRESHOLD``).

    Null and empty texts get the bias alone. A null doc_id is not held out. Other columns are ignored.
    """
    scored = documents.select("doc_id", "text").mapInArrow(_only_id(model), "doc_id long, score double")
    held = F.coalesce(fold(4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _only_id(model: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(scores(b.column("text"), model))], names=["doc_id", "score"])

    return score


def _accepter(model: np.ndarray):
    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(b.column("text"), model) >= THRESHOLD))

    return accept


def accepted(documents: DataFrame, model: np.ndarray) -> DataFrame:
    """The documents, with all their columns, that the classifier doesn't reject. No shuffle."""
    return documents.mapInArrow(_accepter(model), documents.schema)
