"""Bounded training samples of labelled documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of a training sample: labelled documents, and bytes of their whole texts.
MAX_DOCUMENTS = 4000
MAX_BYTES = 24_000_000


def fold(modulus: int):
    """crc32 of the doc_id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, max_documents: int = MAX_DOCUMENTS, max_bytes: int = MAX_BYTES) -> tuple[pa.Array, list[int]]:
    """Whole texts and labels of documents outside the held-out fold, in order of a hash of the doc_id.

    Takes documents until one of the bounds is met; a document that would go beyond the bytes is
    left out. Rows without doc_id or label are no training rows; of repeated ones the first counts.
    """
    spark = documents.sparkSession
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold(modulus) != held))
    picked = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    picked = spark.createDataFrame([tuple(r) for r in picked.collect()], "doc_id long, y int")
    body = F.coalesce(F.col("text"), F.lit(""))
    found = documents.select("doc_id", body.alias("text")).join(F.broadcast(picked), "doc_id")
    sizes = found.select("doc_id", F.octet_length("text").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen, total = [], 0
    for r in sizes.collect():
        if total + r["n"] <= max_bytes:
            chosen.append((r["doc_id"],))
            total += r["n"]
    ids = spark.createDataFrame(chosen, "doc_id long")
    rows = found.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.min("y").alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return pa.array([r["text"] for r in rows], pa.string()), [r["y"] for r in rows]
