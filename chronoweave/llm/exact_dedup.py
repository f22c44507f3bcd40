"""Exact deduplication by a Golomb-coded exchange of fingerprints.

1. One scan gives every document a 64-bit fingerprint and SHA-256 of its normalised text.
2. Where the marks are read, each chunk of rows sorts its fingerprints and sends each owner (a range of fingerprints) the
   gaps between them in Golomb-Rice code, a few bytes a document; nothing else is shuffled to owners.
3. An owner merges what it gets and answers each sender with a bitmap: bit i tells whether the
   sender's i-th fingerprint occurs more than once anywhere. A chunk's rows and its bitmaps meet by the chunk.
4. Only suspects' texts are shuffled. They are grouped by digest and by their bytes, after a
   partial aggregation on the map side, so a text with millions of copies is one row a partition.
5. Group results go back to (partition, digest) pairs, so no key of the last join is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import BROADCAST_NUMBERS, materialise, small

U64 = np.uint64
#: Characters that normalisation deletes.
BLANKS = " \t\n\x0b\x0c\r"
OWNER_ROWS = 500_000


def rice_encode(gaps: np.ndarray) -> tuple[int, bytes, bytes]:
    """Golomb-Rice code of 64-bit gaps: divisor 2^k, quotients in unary, remainders in k bits."""
    if not len(gaps):
        return 0, b"", b""
    mean = float(gaps.astype(np.float64).mean())
    k = min(63, max(0, int(np.log2(max(mean, 1.0)))))
    quotients = (gaps >> U64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    bits = ((gaps[:, None] >> np.arange(k, dtype=U64)) & U64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(bits.ravel()).tobytes()


def rice_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    if not n:
        return np.zeros(0, U64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * k).reshape(n, k).astype(U64)
    low = (bits << np.arange(k, dtype=U64)).sum(axis=1, dtype=U64) if k else np.zeros(n, U64)
    return (quotients.astype(U64) << U64(k)) | low


def owner_of(fingerprints: np.ndarray, owners: int) -> np.ndarray:
    return (((fingerprints >> U64(32)) * U64(owners)) >> U64(32)).astype(np.int64)


def _floor(owner: int, owners: int) -> int:
    return -(-(owner << 32) // owners) << 32


#: Rows of one chunk, a power of two: row ids number the rows of a partition without gaps.
CHUNK_BITS = 16


def _sender(owners: int):
    """Coded blocks of a task's rows (rid, fingerprint): one for each chunk, or part of a chunk, and owner."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def coded(rid: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            mine, rows = np.sort(prints.view(U64)), []
            cuts = np.searchsorted(owner_of(mine, owners), np.arange(owners + 1))
            for owner in np.flatnonzero(np.diff(cuts)):
                part = mine[cuts[owner] : cuts[owner + 1]]
                rows.append((int(owner), int(rid[0] >> CHUNK_BITS), int(rid[0]), len(part), *rice_encode(np.diff(part, prepend=U64(_floor(int(owner), owners))))))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["owner", "chunk", "first", "n", "k", "unary", "rest"])

        for b in batches:
            rid, prints = np.concatenate([rid, b.column("rid").to_numpy()]), np.concatenate([prints, b.column("fingerprint").to_numpy()])
            # a new chunk, or rows that don't follow one another, begin a new sender
            cuts = np.flatnonzero((rid[1:] >> CHUNK_BITS != rid[:-1] >> CHUNK_BITS) | (rid[1:] != rid[:-1] + 1)) + 1
            for a, z in zip([0, *cuts[:-1]], cuts):
                yield coded(rid[a:z], prints[a:z])
            if len(cuts):
                rid, prints = rid[cuts[-1] :], prints[cuts[-1] :]
        if len(rid):
            yield coded(rid, prints)

    return send


def _owner(owners: int):
    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        base = U64(_floor(int(pdf["owner"].iloc[0]), owners))
        with np.errstate(over="ignore"):
            parts = [np.cumsum(rice_decode(n, k, u, r), dtype=U64) + base for n, k, u, r in zip(pdf["n"], pdf["k"], pdf["unary"], pdf["rest"])]
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        twice = np.zeros(len(every), np.uint8)
        twice[order[1:][same]] = 1
        twice[order[:-1][same]] = 1
        bitmaps = [np.packbits(x).tobytes() for x in np.split(twice, np.cumsum([len(p) for p in parts])[:-1])]
        return pd.DataFrame({"chunk": pdf["chunk"], "first": pdf["first"], "owner": pdf["owner"], "n": pdf["n"], "bitmap": bitmaps})

    return answer


def _receive(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Row ids of a chunk's suspects."""
    rows, found = rows.sort_values("rid"), [np.zeros(0, np.int64)]
    rid, prints = rows["rid"].to_numpy(np.int64), rows["fingerprint"].to_numpy(np.int64).view(U64)
    answers = answers.sort_values(["first", "owner"])
    firsts = np.unique(answers["first"].to_numpy(np.int64))
    cuts = np.append(np.searchsorted(rid, firsts), len(rid))
    for first, a, z in zip(firsts, cuts[:-1], cuts[1:]):
        own = answers[answers["first"] == first]
        bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(own["bitmap"], own["n"])])
        if len(bits) != z - a:
            raise ValueError(f"a bitmap of {len(bits)} bits for {z - a} rows")
        found.append(rid[a:z][np.argsort(prints[a:z], kind="stable")][bits.astype(bool)])
    return pd.DataFrame({"suspect": np.concatenate(found)})


def exact_dedup(documents: DataFrame, owners: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chars (code points of the original text).

    Texts are equal when identical without the characters of ``[\\x20\\x09-\\x0D]``; null counts as
    empty, and all empty texts are one group. Of equal texts the row with the most code points
    in its original text stays, then the smallest doc_id (null last), then the first row read, so of
    rows that repeat wholly just one is kept. Other columns are ignored; an empty table gives none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, BLANKS, "")
    marks = materialise(
        documents.select(
            "doc_id",
            F.char_length(text).alias("n_chars"),
            F.xxhash64(bare).alias("fingerprint"),
            F.unhex(F.sha2(bare, 256)).alias("sha"),
            F.spark_partition_id().alias("pid"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    if owners is None:
        owners = max(8, -(-marks.count() // OWNER_ROWS))
    slim = marks.select("rid", "fingerprint")
    sent = slim.mapInArrow(_sender(owners), "owner int, chunk long, first long, n int, k int, unary binary, rest binary")
    answers = sent.groupBy("owner").applyInPandas(_owner(owners), "chunk long, first long, owner int, n int, bitmap binary")
    by_chunk = slim.withColumn("chunk", F.shiftright("rid", CHUNK_BITS)).groupBy("chunk")
    twice = materialise(by_chunk.cogroup(answers.groupBy("chunk")).applyInPandas(_receive, "suspect long"))
    suspects = marks.join(small(twice, BROADCAST_NUMBERS), F.col("rid") == F.col("suspect"), "left_semi")
    ids = small(suspects.select(F.col("doc_id").alias("id")).distinct())
    texts = documents.select("doc_id", bare.alias("bare")).join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    # grouping on the bytes themselves is the verification; two byte strings under one digest end the job
    verified = (
        texts.groupBy(F.unhex(F.sha2("bare", 256)).alias("sha"), "bare")
        .agg(F.count("*").alias("n"))
        .groupBy("sha")
        .agg(F.sum("n").alias("group_size"), F.assert_true(F.count("*") == 1, "two texts have one SHA-256 digest").alias("one"))
        .select("sha", "group_size", "one")
    )
    rank = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("nil"), "doc_id", "rid")
    local = materialise(suspects.groupBy("pid", "sha").agg(F.min(rank).alias("best")))
    groups = materialise(
        local.groupBy("sha")
        .agg(F.min("best").alias("best"))
        .join(verified, "sha")
        .where("one is null")
        .select("sha", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), "group_size")
    )
    back = local.select("pid", "sha").join(groups, "sha")
    out = marks.join(back.withColumnRenamed("pid", "p").withColumnRenamed("sha", "s"), (F.col("pid") == F.col("p")) & (F.col("sha") == F.col("s")), "left")
    alone = F.col("keep_rid").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("n_chars").cast("long").alias("n_chars"),
    )
