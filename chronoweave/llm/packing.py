"""Conflict-constrained best-fit packing of documents into bins of one length.

Documents longer than a bin are cut into pieces. Rows are dealt by a hash to shards of about ``SHARD``
pieces; in each, longest first, a piece goes to the bin with the smallest sufficient residual that is
compatible. Bins are kept by residual; each carries a bitmap of its sources and one of its duplicate
clusters. The search for a bin starts at the successor of the piece's length among the residuals
and goes on until a bin fits whose bitmaps the piece doesn't meet; then a new bin is opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import materialise

CAPACITY = 2048
SHARD = 4096


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each piece. Pieces of one cluster, or of one source, never share a bin."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_residuals, bitmaps, out = 0, [], [0] * len(lengths)
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(sources))}
    cluster_bit = {c: 1 << k for k, c in enumerate(c for c, n in pd.Series(clusters, dtype=object).value_counts().items() if n > 1)}
    for i in order:
        n, s, c = lengths[i], source_bit[sources[i]], cluster_bit.get(clusters[i], 0)
        rest, found = open_residuals >> n, None
        at = n
        while rest:
            skip = (rest & -rest).bit_length() - 1
            at += skip
            found = next((b for b in by_residual[at] if not (bitmaps[b][0] & s or bitmaps[b][1] & c)), None)
            if found is not None:
                break
            rest >>= skip + 1
            at += 1
        if found is None:
            found, at = len(bitmaps), capacity
            bitmaps.append((0, 0))
        else:
            by_residual[at].remove(found)
            if not by_residual[at]:
                open_residuals &= ~(1 << at)
        bitmaps[found] = (bitmaps[found][0] | s, bitmaps[found][1] | c)
        if at - n > 0:
            by_residual[at - n].append(found)
            open_residuals |= 1 << (at - n)
        out[i] = found
    return out


def _packer(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rid", "piece"]).reset_index(drop=True)
        bins = np.array(best_fit(pdf["n_tokens"].tolist(), pdf["source"].tolist(), pdf["cluster"].tolist(), capacity), np.int64)
        pdf["bin_id"] = pdf["shard"].to_numpy(np.int64) * (1 << 20) + bins
        pdf["slot"] = pdf.groupby("bin_id").cumcount()
        return pdf[["doc_id", "piece", "first_token", "n_tokens", "first_byte", "end_byte", "bin_id", "slot"]]

    return pack


def _measured(capacity: int):
    """Lengths of texts, and the bytes at which their pieces begin (plus the end of the last)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = K.buffers(b.column("text"))
            for first, end, part, offs in K.chunks(data, offsets):
                starts, _, at = K.words(part, offs)
                cuts = []
                for a, z, o, e in zip(at[:-1].tolist(), at[1:].tolist(), offs[:-1].tolist(), offs[1:].tolist()):
                    # with a whole number of bins' words, the end token has a piece of its own
                    alone = [e - o] if z > a and (z - a) % capacity == 0 else []
                    cuts.append([0, *(starts[a + capacity : z : capacity] - o).tolist(), *alone, e - o])
                own = b.slice(first, end - first)
                columns = [own.column(c) for c in ("doc_id", "source", "cluster")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(at) + 1, pa.int64()), pa.array(cuts, pa.list_(pa.int64()))], names=["doc_id", "source", "cluster", "length", "cuts"])

    return measure


def pack(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, first_token, n_tokens, first_byte, end_byte, bin_id, slot.

    Tokens are words (runs outside ``[\\x20\\x09-\\x0D]``) and one end token for each document, so
    null and empty texts take 1; the bytes of a piece reach to the next piece's first word. Documents beyond the capacity give
    several pieces, none shared with another of the same document. The duplicate cluster is a hash of the text's letters and
    digits in lower case; null sources are one source. Rows that repeat give pieces of their own, never in one bin; ties in length go
    by place. Other columns are ignored; an empty table gives none. A source stands in a bin once at most, so a corpus
    of few sources fills its bins less. Best fit is exact in each shard of about ``SHARD`` pieces, dealt by a hash.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    cluster = F.xxhash64(F.regexp_replace(F.lower(body), r"[^\p{L}\p{N}]+", ""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("source").cast("string")).alias("source"), cluster.alias("cluster"), body.alias("text"))
    measured = rows.mapInArrow(_measured(capacity), "doc_id long, source long, cluster long, length long, cuts array<long>")
    pieces = F.ceil(F.col("length") / capacity).cast("int")
    marks = measured.withColumn("rid", F.monotonically_increasing_id()).withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    marks = materialise(marks.withColumn("first_byte", F.get("cuts", F.col("piece"))).withColumn("end_byte", F.get("cuts", F.col("piece") + 1)).drop("cuts"))
    shards = max(1, -(-marks.count() // SHARD))
    first = F.col("piece") * F.lit(capacity).cast("long")
    dealt = marks.select(
        "doc_id", "source", "cluster", "rid", "piece", first.alias("first_token"), F.least(F.col("length") - first, F.lit(capacity)).cast("long").alias("n_tokens"), "first_byte", "end_byte",
        F.pmod(F.xxhash64("rid", "piece"), F.lit(shards)).cast("long").alias("shard"),
    )
    return dealt.groupBy("shard").applyInPandas(_packer(capacity), "doc_id long, piece int, first_token long, n_tokens long, first_byte long, end_byte long, bin_id long, slot long")


def sequences(documents: DataFrame, packed: DataFrame, end: str = "\n") -> DataFrame:
    """The packed bins as texts: bin_id, n_tokens, text (the pieces in order of their slots, each followed by ``end``).

    A bin holds at most ``capacity`` tokens, so its pieces are gathered in one row. doc_ids must be unique.
    """
    body = documents.select(F.col("doc_id").cast("long").alias("d"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    pieces = packed.join(body, F.col("doc_id").eqNullSafe(F.col("d")))
    part = F.substring(F.col("raw"), (F.col("first_byte") + 1).cast("int"), (F.col("end_byte") - F.col("first_byte")).cast("int")).cast("string")
    bins = pieces.groupBy("bin_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("slot", part.alias("part")))).alias("p"))
    return bins.select("bin_id", "n_tokens", F.array_join(F.transform("p", lambda x: F.concat(x["part"], F.lit(end))), "").alias("text"))
