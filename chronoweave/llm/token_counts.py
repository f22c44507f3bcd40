"""Token counts through a cache keyed by digests of content and tokenizer.

A cache row holds (content digest, tokenizer digest, tokens, bytes). Documents are digested in one
scan; only one document of each digest that the cache lacks is encoded; its count is appended
to the cache, and all documents take their counts from there by a join on digests.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import BROADCAST_ROWS, materialise, scratch

BATCH_BYTES = 1 << 20
CACHE_SCHEMA = "content binary, tokenizer binary, n_tokens long"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def encoded(path: str, texts: list[str]) -> list[list[int]]:
    """Token ids of each text, without begin, end or added special tokens; about 1 MB at a time."""
    t, out, first, size = tokenizer(path), [], 0, 0
    for k, text in enumerate(texts, 1):
        size += len(text or "")
        if size >= BATCH_BYTES or k == len(texts):
            out += [e.ids for e in t.encode_batch_fast([x or "" for x in texts[first:k]], add_special_tokens=False)]
            first, size = k, 0
    return out


def file_digest(path: str) -> bytes:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).digest()


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = K.buffers(b.column("text"))
            for first, end, part, offs in K.chunks(data, offsets):
                raw = part.tobytes()
                n = [len(ids) for ids in encoded(path, [raw[a:z].decode("utf-8", "replace") for a, z in zip(offs[:-1], offs[1:])])]
                yield pa.RecordBatch.from_arrays([b.column("content").slice(first, end - first), pa.array(n, pa.int64())], names=["content", "n_tokens"])

    return count


def token_counts(documents: DataFrame, tokenizer_path: str, cache_dir: str | None = None, limit: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Null and empty texts have 0 bytes and 0 tokens. Rows that repeat, or have no doc_id, give a row
    each. Other columns are ignored. ``cache_dir`` is a folder of Parquet files in shared storage; a
    folder that isn't there yet is an empty cache, and None means a cache of this call alone. Two calls that
    miss one digest at the same time both append it; readers take each digest once.
    """
    spark = documents.sparkSession
    version = file_digest(tokenizer_path)
    cache_dir = cache_dir or scratch(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_dir)

    def cache() -> DataFrame:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir).where(F.col("tokenizer") == F.lit(version))
        return rows.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))

    digests = materialise(documents.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("content")))
    firsts = digests.groupBy("content").agg(F.min("doc_id").alias("first_id"))
    misses = materialise(firsts.join(cache(), "content", "left_anti"))
    source = documents.select("doc_id", text.alias("text")).withColumn("content", F.unhex(F.sha2("text", 256)))
    n_misses = misses.count()
    if n_misses:
        # the smaller side of the split between "encode" and "leave" is broadcast if it is in bounds
        want = misses.select("content", F.col("first_id").alias("id"))
        on = (source["content"] == F.col("c")) & source["doc_id"].eqNullSafe(F.col("id"))
        leave = digests.join(misses.withColumnRenamed("first_id", "id"), (digests["content"] == misses["content"]) & digests["doc_id"].eqNullSafe(F.col("id")), "left_anti").select(
            "doc_id", digests["content"]
        )
        leave = materialise(leave.select(F.col("doc_id").alias("id"), F.col("content").alias("c")).distinct())
        want = want.select("id", F.col("content").alias("c"))
        if n_misses <= BROADCAST_ROWS // 10:
            todo = source.join(F.broadcast(want), on, "left_semi")
        elif leave.count() <= BROADCAST_ROWS // 2:
            todo = source.join(F.broadcast(leave), on, "left_anti")
        else:
            todo = source.join(want, on, "left_semi")
        new = todo.select("content", "text").mapInArrow(_counter(tokenizer_path), "content binary, n_tokens long")
        new.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_dir)
    # counts meet documents by digest; the copies of one text are first one row each (partition, digest)
    per = digests.withColumn("pid", F.spark_partition_id()).groupBy("pid", "content").agg(F.collect_list(F.struct("doc_id", "n_bytes")).alias("d"))
    out = per.join(cache(), "content").select(F.explode("d").alias("d"), "n_tokens")
    return out.select("d.doc_id", "d.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
