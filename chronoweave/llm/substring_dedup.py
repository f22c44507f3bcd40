"""Passages that repeat across documents: MinHash banding of paragraphs, exact Jaccard, components.

A paragraph ends at a line break and at every sentence end, so a passage pasted into the midst of a line is cut
as it is elsewhere, but for its first and last words. Paragraphs with one sequence of words are one node. A node's bands are
the smallest hashes of its 5-word shingles: of n shingles the first n - ceil(0.8 n) + 1 must hold one that a
similar set's have too, so short sets need one to five bands and lose nothing, and with the bound of ``BANDS`` a long
pair is lost with probability below 0.2 ** 6 (the smallest hashes of the two must all be in one of them only). Colliding nodes
are confirmed on their full sets and clustered (``collide``). Runs of paragraphs with a copy in
another document are passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import collide
from . import kernels as K
from .runtime import BROADCAST_NUMBERS, drop, materialise, small

WORDS, PLAN = 5, collide.Plan(80, 100, 16, 1e-4)
#: Bands of a node at most, one hash each.
BANDS = 6
#: With fewer shingles a set has no other set at the threshold: 3 of 4 is less than 0.8.
LEAST_SHINGLES = 4
#: Words from which a run of repeated paragraphs is a passage.
MIN_WORDS = 25
#: Bytes that a single paragraph without a copy may have between two paragraphs of a run.
GAP_BYTES = 160
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True


def paragraphs(part: np.ndarray, offs: np.ndarray):
    """Paragraphs of a chunk: row, start and end byte, node; word hashes and each paragraph's first one (plus one)."""
    starts, ends, at = K.words(part, offs)
    if not len(starts):
        e = np.zeros(0, np.int64)
        return e, e, e, e, np.zeros(0, K.U64), np.zeros(1, np.int64)
    h = K.hash_words(part, starts, ends)
    lines = np.concatenate([[0], np.cumsum(part == 10)])
    last = _STOPS[part[ends - 1]]
    last[:-1] |= lines[starts[1:]] != lines[ends[:-1]]
    last[at[1:][at[1:] > at[:-1]] - 1] = True
    final = np.flatnonzero(last)
    first = np.concatenate([[0], final + 1])
    row = np.searchsorted(at, final, side="right") - 1
    return row, starts[first[:-1]] - offs[row], ends[final] - offs[row], K.signed(K.hash_runs(h, first)), h, first


def _each(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        data, offsets = K.buffers(b.column("text"))
        ids = b.column("doc_id").cast(pa.int64())
        for first, end, part, offs in K.chunks(data, offsets):
            got = paragraphs(part, offs)
            if len(got[0]):
                yield ids.slice(first, end - first).take(pa.array(got[0])), *got


def _chosen(h: np.ndarray, first: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of some paragraphs, and each one's first (plus one)."""
    sizes = np.diff(first)[take]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    return K.shingles(h[np.repeat(first[take] - begin[:-1], sizes) + np.arange(begin[-1])], begin, WORDS)


def _bands(x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of sets, and each set's first one (plus one); sets too small to be like another have none."""
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    short = x >> K.U64(20)  # 44 bits order the shingles and name the bands
    if len(begin) <= 1 << 20:
        both = np.sort((owner.astype(K.U64) << K.U64(44)) | short)
        owner, short = (both >> K.U64(44)).astype(np.int64), both & K.U64((1 << 44) - 1)
    else:
        order = np.lexsort((short, owner))
        owner, short = owner[order], short[order]
    new = np.ones(len(short), bool)
    new[1:] = (short[1:] != short[:-1]) | (owner[1:] != owner[:-1])
    owner, short = owner[new], short[new]
    first = np.searchsorted(owner, np.arange(len(begin)))
    n = np.diff(first)
    bands = np.where(n >= LEAST_SHINGLES, np.minimum(n + (-n * PLAN.num // PLAN.den) + 1, BANDS), 0)
    keep = np.arange(len(owner)) - first[owner] < bands[owner]
    return K.signed(K.mix(short[keep])), np.concatenate([[0], np.cumsum(bands)])


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, low, high, bands): the smallest and largest doc_id of a chunk's nodes, and their band keys."""
    for ids, _row, _s, _e, node, h, first in _each(batches):
        uniq, place, inverse = np.unique(node, return_index=True, return_inverse=True)
        doc = ids.to_numpy(zero_copy_only=False)
        low, high = np.full(len(uniq), np.iinfo(np.int64).max), np.full(len(uniq), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, doc)
        np.maximum.at(high, inverse, doc)
        keys, begin = _bands(*_chosen(h, first, place))
        bands = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(keys))
        yield pa.RecordBatch.from_arrays([pa.array(uniq), pa.array(low), pa.array(high), bands], names=["node", "low", "high", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ids, _row, _s, _e, node, h, first in _each(batches):
        uniq, place = np.unique(node, return_index=True)
        x, begin = _chosen(h, first, place)
        own = [np.unique(x[a:z]) for a, z in zip(begin[:-1], begin[1:])]
        sizes = np.array([len(s) for s in own])
        keep = pa.array(sizes >= LEAST_SHINGLES)
        made = [pa.array(uniq), pa.array(sizes, pa.int64()), collide.fixed_binary(collide.signatures(x, begin, PLAN)), pa.array([s.tobytes() for s in own], pa.binary())]
        yield pa.RecordBatch.from_arrays(made, names=["id", "n_shingles", "sig", "own"]).filter(keep)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, row, s, e, node, _h, first in _each(batches):
        no = np.arange(len(row)) - np.searchsorted(row, row)
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, pa.int64()) for v in (no, s, e, np.diff(first), node))], names=["doc_id", "no", "start", "end", "n_words", "node"])


def _parts(min_words: int):
    """Rows of documents' repeated paragraphs, whole documents together and in order, to parts of passages."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in collide.in_runs(batches, "doc_id"):
            doc, no, start, end, n, cluster, first_doc = (table.column(c).to_numpy() for c in ("doc_id", "no", "start", "end", "n_words", "cluster", "first_doc"))
            once = np.zeros(len(doc), bool)
            order = np.lexsort((np.arange(len(doc)), cluster, doc))
            once[order[np.concatenate([[True], (doc[order][1:] != doc[order][:-1]) | (cluster[order][1:] != cluster[order][:-1])])]] = True
            removed = ~(once & (doc == first_doc))
            other, step = np.ones(len(doc), bool), np.zeros(len(doc), np.int64)
            other[1:], step[1:] = doc[1:] != doc[:-1], no[1:] - no[:-1]
            near = np.zeros(len(doc), bool)
            near[1:] = (step[1:] <= 1) | ((step[1:] == 2) & (start[1:] - end[:-1] <= GAP_BYTES))
            run = np.cumsum(other | ~near)
            turn = other | (step > 1)
            turn[1:] |= removed[1:] != removed[:-1]
            keep = np.bincount(run, n)[run] >= min_words
            doc, start, end, n, cluster, removed, part = (v[keep] for v in (doc, start, end, n, cluster, removed, np.cumsum(turn)))
            if not len(doc):
                continue
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            own = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(doc))))
            order = np.lexsort((cluster, own))
            new = np.concatenate([[True], (own[order][1:] != own[order][:-1]) | (cluster[order][1:] != cluster[order][:-1])])
            cuts = np.concatenate([[0], np.cumsum(np.bincount(own[order][new], minlength=len(at)))])
            clusters = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(cluster[order][new]))
            columns = [doc[at], np.minimum.reduceat(start, at), np.maximum.reduceat(end, at), np.add.reduceat(n, at), clusters, removed[at]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["doc_id", "start", "end", "n_words", "clusters", "removed"])

    return parts


def substring_dedup(documents: DataFrame, min_words: int = MIN_WORDS, block: int = collide.BLOCK) -> DataFrame:
    """Passages that repeat across documents, in parts to keep or remove: doc_id, start, end, n_words, clusters, removed.

    A passage is a run of paragraphs of ``min_words`` words or more, each with a near copy (5-word
    shingles, Jaccard 0.8) in another document; one paragraph of at most ``GAP_BYTES`` bytes without a copy may lie between two
    of them. It gives a row for each longest part of neighbours that
    all are the first of their cluster (smallest doc_id, then place; removed is false) or all are not
    (removed is true), so a part may be shorter; start and end are byte offsets, clusters the
    sorted ids of its paragraphs' clusters. Documents without such a passage have no row. Null and empty
    texts have none; rows without a doc_id are left out, and rows that share one count as one document.
    A paragraph of fewer than ``LEAST_SHINGLES`` shingles has no near copy but its own sequence of words. Other columns
    are ignored; an empty table gives none.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    marks = materialise(docs.mapInArrow(_post, "node long, low long, high long, bands array<long>"))
    home = materialise(marks.groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    zero = F.lit(0).cast("long")
    posts = marks.select(F.col("node").alias("doc_id"), zero.alias("p1"), F.lit(-1).alias("c0"), F.explode("bands").alias("key"))
    made: list[DataFrame] = []

    def payload_of(ids: DataFrame) -> DataFrame:
        nodes = small(ids.withColumnRenamed("doc_id", "i"), BROADCAST_NUMBERS)
        where = materialise(home.join(nodes, F.col("node") == F.col("i"), "left_semi").select(F.col("low").alias("d")).distinct())
        texts = docs.join(small(where), F.col("doc_id") == F.col("d"), "left_semi")
        sets = texts.mapInArrow(_sets, "id long, n_shingles long, sig binary, own binary").join(nodes, F.col("id") == F.col("i"), "left_semi")
        made.append(materialise(sets.dropDuplicates(["id"])))
        return made[0].select(F.col("id").alias("doc_id"), zero.alias("d1"), "n_shingles", "sig")

    def sets_of(ids: DataFrame) -> DataFrame:
        own = made[0].select("id", zero.alias("d1"), "own")
        return own.join(small(ids.withColumnRenamed("doc_id", "i"), BROADCAST_NUMBERS), F.col("id") == F.col("i"), "left_semi")

    roots = collide.linked(posts, payload_of, sets_of, PLAN, block)
    drop(marks, *made)
    alone = home.where("low < high").join(small(roots.select(F.col("node").alias("r")), BROADCAST_NUMBERS), F.col("node") == F.col("r"), "left_anti")
    with_root = home.join(small(roots.withColumnRenamed("node", "r"), BROADCAST_NUMBERS), F.col("node") == F.col("r"))
    members = materialise(with_root.select("node", F.col("root").alias("cluster"), "low", "high"))
    clusters = members.groupBy("cluster").agg(F.min("low").alias("first_doc"), F.max("high").alias("last_doc")).where("first_doc < last_doc")
    wanted = members.select("node", "cluster").join(clusters.select("cluster", "first_doc"), "cluster").select("node", "cluster", "first_doc")
    wanted = materialise(wanted.unionByName(alone.select("node", F.col("node").alias("cluster"), F.col("low").alias("first_doc"))))
    drop(home, roots, members)
    found = docs.mapInArrow(_occurrences, "doc_id long, no long, start long, end long, n_words long, node long").join(small(wanted, BROADCAST_NUMBERS), "node").drop("node")
    together = found.repartition("doc_id").sortWithinPartitions("doc_id", "no", "start")
    return together.mapInArrow(_parts(min_words), "doc_id long, start long, end long, n_words long, clusters array<long>, removed boolean")
