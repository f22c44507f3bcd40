"""Near-duplicate documents by an inverted join on MinHash signature coordinates.

Documents with one shingle set are one node, found by a digest of the set. Nodes are posted under the
(coordinate, value) pairs of a short prefix of their signatures; in each posting list the equal coordinates of
whole signatures are counted (the other coordinates are never posted), and pairs with at least T of them are
confirmed on the shingle sets. ``collide`` has the lists, and says how they stay bounded; prefix
length and T follow from the similarity: each loses a pair at the threshold with probability below ``MISS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import collide
from . import kernels as K
from .runtime import drop, materialise, small

COORDINATES = 128
MISS = 1e-6


def _chunks(batches: Iterator[pa.RecordBatch], n: int):
    """doc_ids, shingle hashes and each row's first one (plus one), by chunks."""
    for batch in batches:
        data, offsets = K.buffers(batch.column("text"))
        for first, end, part, offs in K.chunks(data, offsets):
            starts, ends, at = K.words(part, offs)
            yield batch.slice(first, end - first), *K.shingles(K.hash_words(part, starts, ends), at, n)


def _own(x: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    return [np.unique(x[a:z]) for a, z in zip(begin[:-1], begin[1:])]


def _scan(n: int, plan: collide.Plan):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, begin in _chunks(batches, n):
            own = _own(x, begin)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in own], pa.int64()),
                    pa.array(np.array([s.sum(dtype=K.U64) for s in own], K.U64).view(np.int64)),
                    pa.array(np.array([K.mix(s).sum(dtype=K.U64) for s in own], K.U64).view(np.int64)),
                    collide.fixed_binary(collide.signatures(x, begin, plan)),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "sig"],
            )

    return scan


def _sets(n: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, begin in _chunks(batches, n):
            own = _own(x, begin)
            d1 = np.array([s.sum(dtype=K.U64) for s in own], K.U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(d1), pa.array([s.tobytes() for s in own], pa.binary())], names=["id", "d1", "own"])

    return scan


def near_dedup(documents: DataFrame, words: int = 5, num: int = 80, den: int = 100, block: int = collide.BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct ``words``-word shingles (A-Z lower-cased, words as in
    ``kernels``), the whole sequence if it has fewer words, nothing if it has none; shingles are told apart by
    64-bit hashes, and whole sets by two further sums of them. Documents with
    den * intersection >= num * union are linked; component_id is the smallest doc_id reachable.
    Null and empty texts are linked with nothing. A row without a doc_id has a null component_id and
    is kept. Rows that share a doc_id are one document, linked with what any of their texts is linked with.
    Rows that repeat wholly give a row each. Other columns are ignored; an empty table gives none.
    """
    plan = collide.Plan(num, den, COORDINATES, MISS)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = docs.mapInArrow(_scan(words, plan), "doc_id long, n_shingles long, d1 long, d2 long, sig binary")
    marks = materialise(marks.withColumn("pid", F.spark_partition_id()))
    digest = ["d1", "d2", "n_shingles"]
    some = marks.where("n_shingles > 0 and doc_id is not null")
    reps = some.groupBy(digest).agg(F.min_by(F.struct("doc_id", "sig"), "doc_id").alias("r"), F.count("*").alias("copies"))
    reps = materialise(reps.select(*digest, "r.doc_id", "r.sig", "copies"))

    def sets_of(ids: DataFrame) -> DataFrame:
        return docs.join(small(ids.withColumnRenamed("doc_id", "i")), F.col("doc_id") == F.col("i"), "left_semi").mapInArrow(_sets(words), "id long, d1 long, own binary").distinct()

    def payload_of(ids: DataFrame) -> DataFrame:
        return reps.select("doc_id", "d1", "n_shingles", "sig").join(small(ids.withColumnRenamed("doc_id", "i")), F.col("doc_id") == F.col("i"), "left_semi")

    roots = collide.linked(collide.posted(reps, plan), payload_of, sets_of, plan, block)
    # rows whose component isn't their own doc_id; a digest with many copies is first one row for each partition
    moved = reps.join(roots, F.col("doc_id") == F.col("node"), "left").where("copies > 1 or root is not null").select(*digest, F.coalesce("root", "doc_id").alias("component"))
    local = marks.where("n_shingles > 0").groupBy("pid", *digest).agg(F.lit(1).alias("one")).drop("one")
    back = local.join(small(materialise(moved)), digest).withColumnsRenamed({c: f"_{c}" for c in ("pid", *digest)})
    out = marks.join(back, [F.col(c) == F.col(f"_{c}") for c in ("pid", *digest)], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    out = materialise(out)
    drop(marks, reps, roots)
    return out
