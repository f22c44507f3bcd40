"""Token ids in files: frequency-ranked ids, byte-aligned variable-length codes, separate control bytes.

A block holds some documents in order. Ids are replaced by their rank in the corpus (0: the most
frequent), each rank takes 1 to 4 little-endian bytes, and the byte counts less one lie
apart, four to a control byte (2 bits each, lowest first). numpy decodes a block by table
lookup: control byte -> four lengths, then one gather for each byte place. Blocks are rows of a
Parquet table in shared storage, ordered by (shard, block); ``ranks`` beside it maps ranks to ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from . import pieces
from .runtime import drop, materialise, scratch
from .token_counts import tokenizer

#: Ids of one block, about; a longer document has a block of its own.
BLOCK_IDS = 1 << 18
#: Ids of one shard, about: what one task sorts and writes (2 or 4 bytes each before coding).
SHARD_IDS = 1 << 23
#: Lengths (1 to 4) of the four values of every control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = values.astype("<u4")
    sizes = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = sizes - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    raw = values.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < sizes[:, None]].tobytes()


def unpack(n: int, control: bytes, data: bytes) -> np.ndarray:
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    begin = np.cumsum(sizes) - sizes
    out = np.zeros(n, np.uint32)
    for place in range(4):
        has = sizes > place
        out[has] |= raw[begin[has] + place].astype(np.uint32) << np.uint32(8 * place)
    return out


def width(path: str, end_id: int) -> str:
    """The little-endian type that holds every id of a vocabulary."""
    return "<u2" if max(tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def _encode(path: str, end_id: int, kind: str):
    """Ids of every text as numbers of the given type; each task's last row has no text but its counts of ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            data, offsets = K.buffers(b.column("text"))
            for first, end, part, offs in K.chunks(data, offsets, pieces.CHUNK):
                flat, sizes = pieces.ids_of(path, part, offs, end_id)
                seen = np.bincount(flat, minlength=len(total))
                seen[: len(total)] += total
                total = seen
                yield _coded(b.column("doc_id").slice(first, end - first), sizes, flat.astype(kind))
        ids = np.flatnonzero(total)
        counts = pa.array([np.stack([ids, total[ids]]).astype("<i8").tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), counts], names=["doc_id", "n", "ids", "counts"])

    return encode


def _coded(doc_id: pa.Array, sizes: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * flat.itemsize
    ids = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([doc_id, pa.array(sizes, pa.int64()), ids, pa.nulls(len(sizes), pa.binary())], names=["doc_id", "n", "ids", "counts"])


def _writer(rank_of: np.ndarray, kind: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, start = TaskContext.get().partitionId(), 0, 0
        docs, parts, size = [], [], 0

        def out():
            nonlocal docs, parts, size, block, start
            control, data = pack(np.concatenate(parts))
            row = {"shard": [shard], "block": [block], "start": [start], "n": [size], "doc_ids": [docs], "lengths": [[len(p) for p in parts]], "control": [control], "data": [data]}
            block, start, docs, parts = block + 1, start + size, [], []
            size = 0
            return pa.RecordBatch.from_pydict(row, schema=_ARROW)

        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                docs.append(d)
                parts.append(rank_of[np.frombuffer(x.as_buffer(), kind)])
                size += len(parts[-1])
                if size >= BLOCK_IDS:
                    yield out()
        if docs:
            yield out()

    return write


_ARROW = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())]
)
_BLOCKS = "shard int, block int, start long, n long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def write_tokens(documents: DataFrame, tokenizer_path: str, end_id: int, path: str) -> None:
    """Encodes all ``documents`` and writes blocks and ranks below ``path``, in ascending doc_id order.

    Null texts count as empty (just the end id). Rows without a doc_id come first; rows that share
    a doc_id follow one another, ordered by length and ids. Other columns are ignored. The driver takes one
    table of counts from each task in turn, and makes the rank table; both are bounded by the vocabulary.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = width(tokenizer_path, end_id)
    coded = materialise(docs.mapInArrow(_encode(tokenizer_path, end_id, kind), "doc_id long, n long, ids binary, counts binary"))
    total = np.zeros(1, np.int64)
    for row in coded.where("counts is not null").select("counts").toLocalIterator():
        ids, n = np.frombuffer(row["counts"], "<i8").reshape(2, -1)
        total = np.pad(total, (0, max(0, int(ids.max(initial=0)) + 1 - len(total))))
        total[ids] += n
    by_rank = np.lexsort((np.arange(len(total)), -total))[: np.count_nonzero(total)].tolist()
    rank_of = np.zeros(len(total), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shards = max(8, -(-int(total.sum()) // SHARD_IDS))
    ordered = coded.where("counts is null").select("doc_id", "n", "ids").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "n", "ids")
    ordered.mapInArrow(_writer(rank_of, kind), _BLOCKS).write.parquet(f"{path}/blocks")
    spark = docs.sparkSession
    spark.createDataFrame(list(enumerate(by_rank)), "rank int, id int").write.parquet(f"{path}/ranks")
    drop(coded)


def _reader(ids: np.ndarray, before: dict[int, int]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                tokens = ids[unpack(row["n"], row["control"], row["data"])].astype("<u4")
                cuts = np.concatenate([[0], np.cumsum(row["lengths"])])
                first = before[row["shard"]] + row["start"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(first + cuts[:-1], pa.int64()),
                        pa.array(row["lengths"], pa.int64()),
                        pa.array([tokens[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:])], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return read


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian 32-bit) of each document, decoded from the files.

    The driver takes the rank table (bounded by the vocabulary) and one total for each shard.
    """
    ranks = spark.read.schema("rank int, id int").parquet(f"{path}/ranks").collect()
    ids = np.zeros(max(1, len(ranks)), np.uint32)
    for r in ranks:
        ids[r["rank"]] = r["id"]
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()
    before, at = {}, 0
    for r in sorted(totals, key=lambda r: r["shard"]):
        before[r["shard"]], at = at, at + r["n"]
    return blocks.mapInArrow(_reader(ids, before), "doc_id long, start long, n_tokens long, ids binary")


def token_files(documents: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes the files and returns what ``read_tokens`` reads back from them."""
    spark = documents.sparkSession
    path = path or scratch(spark)
    write_tokens(documents, tokenizer_path, end_id, path)
    return read_tokens(spark, path)


def digests(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").cast(T.LongType()).alias("ids_crc32"))
