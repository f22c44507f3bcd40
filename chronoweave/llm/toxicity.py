"""Toxic spans by a linear-chain conditional random field on words, summed up to document scores.

Words have two states. A word's features are hashes of it, of its first 3 to 8 bytes and of its last 4;
the chain has start weights and transition weights. Forward-backward marginals are exact, computed
for a whole batch as products of 2x2 matrices (a document's first matrix forgets what was before).

Labels are given for documents, so words are labelled first: in toxic documents the words with a
feature that is much more common in toxic than in clean documents. Half of the sample trains the
field, the other half the regression from sums of marginals to a document's score.
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
PREFIXES = (3, 4, 5, 6, 8)
EPOCHS, RATE, DECAY = 6, 0.3, 1e-5
#: A feature marks toxic words if that many toxic documents have it, and so many times the clean share.
SUPPORT, LIFT = 4, 6.0
#: A marginal from which a word belongs to a span.
SPAN = 0.5


def word_features(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Slots (features x words)."""
    kinds = [K.hash_words(part, starts, ends)]
    kinds += [K.hash_words(part, starts, np.minimum(ends, starts + k)) for k in PREFIXES]
    kinds.append(K.hash_words(part, np.maximum(starts, ends - 4), ends))
    with np.errstate(over="ignore"):
        return np.array([K.mix(h + K.U64(101 * i + 7)) >> K.U64(64 - BITS) for i, h in enumerate(kinds)]).astype(np.int64)


def _product(m: np.ndarray) -> np.ndarray:
    """For matrices m (4 x n: aa ab ba bb) the row vectors of (1 1) m[0] ... m[t], each scaled to sum 1."""
    n = m.shape[1]
    if not n:
        return np.zeros((2, 0))
    length = max(1, int(np.sqrt(n)))
    blocks = -(-n // length)
    full = np.zeros((4, blocks * length))
    full[0], full[3] = 1.0, 1.0
    full[:, :n] = m
    a = np.ascontiguousarray(full.reshape(4, blocks, length).transpose(2, 0, 1))
    for i in range(1, length):
        p, q = a[i - 1], a[i]
        new = np.array([p[0] * q[0] + p[1] * q[2], p[0] * q[1] + p[1] * q[3], p[2] * q[0] + p[3] * q[2], p[2] * q[1] + p[3] * q[3]])
        a[i] = new / new.max(axis=0)
    carry, v = np.empty((2, blocks)), np.array([0.5, 0.5])
    for b in range(blocks):
        carry[:, b] = v
        last = a[-1, :, b]
        v = np.array([v[0] * last[0] + v[1] * last[2], v[0] * last[1] + v[1] * last[3]])
        v = v / v.sum()
    out = np.stack([carry[0] * a[:, 0] + carry[1] * a[:, 2], carry[0] * a[:, 1] + carry[1] * a[:, 3]])
    out = out / out.sum(axis=0)
    return out.transpose(0, 2, 1).reshape(2, -1)[:, :n]


def marginals(unary: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each word, and the sums of pair marginals (4: from state x to state).

    ``unary`` are log weights of the toxic state, ``first`` the indexes of documents' first words
    (plus one end), ``trans`` four log weights, ``start`` the log weight of a toxic first word.
    """
    n = len(unary)
    if not n:
        return np.zeros(0), np.zeros(4)
    begins = np.unique(first[:-1][np.diff(first) > 0])
    u = np.exp(np.clip(unary, -30, 30))
    e = np.exp(trans)
    m = np.stack([np.full(n, e[0]), e[1] * u, np.full(n, e[2]), e[3] * u])
    m[0, begins] = m[2, begins] = 1.0
    m[1, begins] = m[3, begins] = np.exp(start) * u[begins]
    alpha = _product(m / m.max(axis=0))
    back = np.ones((4, n))
    inner = np.ones(n, bool)
    inner[begins] = False
    follow = np.flatnonzero(inner)  # word t whose document has a word t - 1
    back[:, follow - 1] = np.stack([m[0], m[2], m[1], m[3]])[:, follow]
    ends = np.concatenate([begins[1:], [n]]) - 1
    back[:, ends] = 1.0
    beta = _product((back / back.max(axis=0))[:, ::-1])[:, ::-1]
    both = alpha * beta
    p = both[1] / both.sum(axis=0)
    pair = np.stack([alpha[i, follow - 1] * m[2 * i + j, follow] * beta[j, follow] for i in (0, 1) for j in (0, 1)])
    return p, (pair / pair.sum(axis=0)).sum(axis=1) if len(follow) else np.zeros(4)


def aggregates(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What a document's score is made of: a constant and sums of its marginals."""
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    total = np.bincount(rows, p, minlength=len(n))
    sure = np.bincount(rows, p > SPAN, minlength=len(n))
    top = np.zeros(len(n))
    np.maximum.at(top, rows, p)
    return np.stack([np.ones(len(n)), np.log1p(total), np.log1p(sure), top, np.sqrt(total / np.maximum(n, 1))], axis=1)


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = K.buffers(texts)
    for a, z, part, offs in K.chunks(data, offsets, 1 << 18):
        starts, ends, at = K.words(part, offs)
        yield a, z, word_features(part, starts, ends), at, starts, ends, offs


def train(texts: pa.Array, labels: list[int]) -> dict[str, np.ndarray]:
    """The field's and the regression's weights; the same for the same rows. No rows give zeros."""
    y = np.array(labels, np.int64)
    weights, trans, start, regression = np.zeros(DIM), np.zeros(4), np.zeros(1), np.zeros(5)
    model = {"weights": weights, "trans": trans, "start": start, "regression": regression}
    parts = [(y[a:z], f, at) for a, z, f, at, *_ in _parts(texts)]
    counts = np.zeros((2, DIM))
    for own, f, at in parts:
        rows = np.repeat(np.arange(len(own)), np.diff(at))
        slots = np.unique((rows[None, :] << BITS) | f)
        np.add.at(counts, (own[slots >> BITS], slots & (DIM - 1)), 1)
    docs = np.maximum(np.bincount(y, minlength=2), 1)
    lift = (counts[1] / docs[1]) / ((counts[0] + 1) / docs[0])
    mark = (counts[1] >= SUPPORT) & (lift >= LIFT)
    sums = {k: np.full_like(v, 1e-2) for k, v in model.items()}
    half = lambda at, own, a: (a + np.arange(len(own))) % 2 == 0
    for _ in range(EPOCHS):
        a = 0
        for own, f, at in parts:
            mine = half(at, own, a)
            a += len(own)
            n = np.diff(at)
            word = np.repeat(mine, n)
            first = np.concatenate([[0], np.cumsum(n[mine])])
            g, toxic = f[:, word], np.repeat(own[mine], n[mine]).astype(bool)
            if not len(toxic):
                continue
            truth = (toxic & mark[g].any(axis=0)).astype(np.float64)
            p, pairs = marginals(weights[g].sum(axis=0), first, trans, start[0])
            inner = np.ones(len(p), bool)
            begins = np.unique(first[:-1][np.diff(first) > 0])
            inner[begins] = False
            t = np.flatnonzero(inner)
            seen = np.bincount((2 * truth[t - 1] + truth[t]).astype(int), minlength=4)
            step = {
                "weights": np.bincount(g.ravel(), np.tile(p - truth, len(g)), minlength=DIM) + DECAY * weights * len(p),
                "trans": (pairs - seen),
                "start": np.array([(p[begins] - truth[begins]).sum()]),
            }
            for k, d in step.items():
                sums[k] += d * d
                model[k] -= RATE * d / np.sqrt(sums[k])
    x, target, a = [], [], 0
    for own, f, at in parts:
        mine = ~half(at, own, a)
        a += len(own)
        x.append(aggregates(marginals(weights[f].sum(axis=0), at, trans, start[0])[0], at)[mine])
        target.append(own[mine])
    if x and len(np.concatenate(target)):
        x, target = np.concatenate(x), np.concatenate(target)
        for _ in range(30):  # Newton steps of a ridge logistic regression
            q = 1 / (1 + np.exp(-np.clip(x @ regression, -30, 30)))
            hessian = (x * (q * (1 - q))[:, None]).T @ x + 0.3 * np.eye(5)
            regression -= np.linalg.solve(hessian, x.T @ (q - target) + 0.3 * regression)
    return {k: v.astype(np.float32) for k, v in model.items()}


def scores(texts: pa.Array, model: dict[str, np.ndarray]) -> tuple[np.ndarray, list[list[dict[str, int]]]]:
    """Scores, and for each text its toxic spans as byte offsets."""
    out, spans = np.zeros(len(texts)), []
    trans, start = model["trans"].astype(float), float(model["start"][0])
    for a, z, f, at, starts, ends, offs in _parts(texts):
        p, _ = marginals(model["weights"][f].sum(axis=0), at, trans, start)
        out[a:z] = 1 / (1 + np.exp(-np.clip(aggregates(p, at) @ model["regression"], -30, 30)))
        rows = np.searchsorted(at, np.flatnonzero(p > SPAN), side="right") - 1
        got: list[list[dict[str, int]]] = [[] for _ in range(z - a)]
        last = -2
        for w, r in zip(np.flatnonzero(p > SPAN), rows):
            if last == w - 1 and got[r]:
                got[r][-1]["end"] = int(ends[w] - offs[r])
            else:
                got[r].append({"start": int(starts[w] - offs[r]), "end": int(ends[w] - offs[r])})
            last = w
        spans += got
    return out, spans


def _scorer(model: dict[str, np.ndarray]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            s, spans = scores(b.column("text"), model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(s), pa.array(spans, span)], names=["doc_id", "score", "spans"])

    return score


def fit(documents: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS, max_bytes: int = MAX_BYTES) -> dict[str, np.ndarray]:
    """A model from labelled documents whose crc32(doc_id) mod 3 is not 1, within the two bounds."""
    return train(*sample(documents, labels, "toxic", 3, 1, max_documents, max_bytes))


def toxicity(documents: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, spans (byte offsets of toxic words' runs).

    Null and empty texts get the regression's constant and no spans. A null doc_id is not held out. Other
    columns are ignored.
    """
    scored = documents.select("doc_id", "text").mapInArrow(_scorer(model), "doc_id long, score double, spans array<struct<start:long,end:long>>")
    held = F.coalesce(fold(3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
