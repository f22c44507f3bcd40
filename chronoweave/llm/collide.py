"""Links between sets that agree on signature coordinates: the posting lists behind both near-duplicate operators.

A set's signature has ``heads`` coordinates of 32 bits and further ones of 8. It is posted under every (coordinate,
value) of the heads. A list of more than ``BLOCK`` members is dealt out again by the next coordinates; what
is then still too long (a large group of alike sets) is cut into blocks by a hash. Each list is one run of rows
of a sorted partition, so no task holds more than one list:

1. equal coordinates are counted; members without a partner that has enough of them are dropped. A pair counts in the
   list of the first head on which it agrees and in no other;
2. those that stay get their sets, and the pairs are confirmed on them. A task gives a spanning forest of
   its list's links, so it emits fewer edges than it has members, however many pairs are alike;
3. of lists that were cut into blocks, the members outside the largest component so far are held against all blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .runtime import BROADCAST_NUMBERS, drop, materialise, small

#: Most members of a list that one task holds against each other.
BLOCK = 4096
#: Most shingles of a list's sets that one task holds; a list beyond is cut into pairs of blocks.
LIST_SHINGLES = 2 << 20
#: Lists up to this length are counted many at a time.
SHORT, SHORT_PAIRS = 64, 1 << 16
#: Coordinates that are counted first.
FIRST = 32


def _least(n: int, similarity: float, miss: float) -> int:
    """The largest count of n coordinates below which a pair of that similarity falls with probability under ``miss``."""
    tail, least = 0.0, 0
    while True:
        p = math.comb(n, least) * similarity**least * (1 - similarity) ** (n - least)
        if tail + p > miss:
            return least
        tail, least = tail + p, least + 1


@dataclass(frozen=True)
class Plan:
    """How signatures are made and counted; every step loses a pair at the threshold with probability below ``miss``."""

    num: int
    den: int
    coordinates: int
    miss: float

    @property
    def heads(self) -> int:
        return max(1, math.ceil(math.log(self.miss) / math.log(1 - self.num / self.den)))

    @property
    def width(self) -> int:
        return 3 * self.heads + self.coordinates

    def least(self, n: int) -> int:
        return _least(n, self.num / self.den, self.miss)


@lru_cache(maxsize=8)
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return K.stream(n, 5) | K.U64(1), K.stream(n, 6)


def signatures(x: np.ndarray, begin: np.ndarray, plan: Plan) -> np.ndarray:
    """Signatures (rows x ``plan.width`` bytes) of runs of shingle hashes; empty runs give zeros."""
    full = np.flatnonzero(np.diff(begin))
    values = np.zeros((plan.coordinates, len(begin) - 1), np.uint32)
    if len(full):
        a, b = _multipliers(plan.coordinates)
        with np.errstate(over="ignore"):
            for i in range(plan.coordinates):
                values[i, full] = np.minimum.reduceat(x * a[i] + b[i], begin[full]) >> K.U64(32)
    heads = np.ascontiguousarray(values[: plan.heads].T).astype("<u4").view(np.uint8)
    return np.concatenate([heads, (values[plan.heads :] & 255).astype(np.uint8).T], axis=1)


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


# Lists in a task.

_PART_BOTH, _PART_MEMBER, _PART_PROBE = 0, 1, 2


def in_runs(batches: Iterator[pa.RecordBatch], by: str = "lid") -> Iterator[pa.Table]:
    """Tables of whole runs: rows come sorted by the column ``by``, and a run may lie across batches."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        lid = b.column(by).to_numpy()
        cut = len(lid) - int((lid[::-1] != lid[-1]).argmax()) if lid[0] != lid[-1] else 0
        if cut or (rest and rest[-1].column(by)[-1].as_py() != lid[0]):
            yield pa.Table.from_batches([*rest, b.slice(0, cut)] if cut else rest).combine_chunks()
            rest = []
        rest.append(b.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _bytes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    data, _ = K.buffers(column)
    return data.reshape(-1, width)


@lru_cache(maxsize=SHORT + 1)
def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


class Lists:
    """The rows of some lists, and the pairs in them that may be linked."""

    def __init__(self, table: pa.Table, plan: Plan):
        self.plan = plan
        self.doc, self.n, self.label = (_numbers(table, c) for c in ("doc_id", "n_shingles", "label"))
        self.part, self.c0, self.c1 = (_numbers(table, c) for c in ("part", "c0", "c1"))
        self.sig = _bytes(table.column("sig"), plan.width)
        self.heads = np.ascontiguousarray(self.sig[:, : 4 * plan.heads]).view("<u4")
        self.tails = self.sig[:, 4 * plan.heads :]
        lid = _numbers(table, "lid")
        self.cuts = np.flatnonzero(np.concatenate([[True], lid[1:] != lid[:-1], [True]])) if len(lid) else np.zeros(1, np.int64)

    def good(self, i: np.ndarray, j: np.ndarray, counted: bool = False) -> np.ndarray:
        """Which pairs of rows differ in label, could be alike by size, agree enough, and belong to this list."""
        low, high = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        ok = (self.label[i] != self.label[j]) & (low * self.plan.den >= high * self.plan.num)
        i, j, at = i[ok], j[ok], np.flatnonzero(ok)
        same = self.heads[i] == self.heads[j]
        c0, c1 = self.c0[i], self.c1[i]
        mine = (c0 < 0) | (same.argmax(axis=1) == c0)
        equal = self.tails[i] == self.tails[j]
        mine &= (c1 < 0) | (equal[:, : self.plan.heads].argmax(axis=1) == c1)
        if not counted:
            mine &= same.sum(axis=1) + equal.sum(axis=1, dtype=np.int64) >= self.plan.least(self.plan.coordinates)
        out = np.zeros(len(ok), bool)
        out[at[mine]] = True
        return out

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidate pairs (i, j) of rows, list by list; a long list's come in several parts."""
        firsts, seconds, held = [], [], 0
        for a, z in zip(self.cuts[:-1], self.cuts[1:]):
            if z - a <= SHORT and not self.part[a:z].any():
                i, j = _triangle(int(z - a))
                firsts.append(i + a)
                seconds.append(j + a)
                held += len(i)
                if held >= SHORT_PAIRS:
                    yield self._kept(np.concatenate(firsts), np.concatenate(seconds))
                    firsts, seconds, held = [], [], 0
            else:
                yield from self._long(int(a), int(z))
        if held:
            yield self._kept(np.concatenate(firsts), np.concatenate(seconds))

    def _kept(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = self.good(i, j)
        return i[keep], j[keep]

    def _long(self, a: int, z: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        part = self.part[a:z]
        probes, members = a + np.flatnonzero(part != _PART_MEMBER), a + np.flatnonzero(part != _PART_PROBE)
        some = min(FIRST, self.tails.shape[1])
        least, step = self.plan.least(some), max(1, (1 << 19) // max(1, len(members)))
        columns = np.ascontiguousarray(self.tails[members, :some].T)
        for first in range(0, len(probes), step):
            own = probes[first : first + step]
            count = np.zeros((len(own), len(members)), np.uint8)
            for c in range(some):
                count += self.tails[own, c][:, None] == columns[c][None, :]
            i, j = np.nonzero(count >= least)
            i, j = own[i], members[j]
            once = (i < j) | (self.part[i] == _PART_PROBE)
            yield self._kept(i[once], j[once])


def _collide(plan: Plan):
    """The rows that have a candidate in their list."""

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_runs(batches):
            lists, keep = Lists(table, plan), np.zeros(table.num_rows, bool)
            for i, j in lists.pairs():
                keep[i] = keep[j] = True
            yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

    return collide


def _forest(plan: Plan):
    """Edges (a, b) that join the members of every list as all its links do."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_runs(batches):
            lists, edges = Lists(table, plan), []
            raw, offsets = K.buffers(table.column("own"))
            begin, x = offsets // 8, np.frombuffer(raw.tobytes(), K.U64)
            sizes = np.diff(begin)
            ids = np.unique(x, return_inverse=True)[1] if len(x) else np.zeros(0, np.int64)
            lab = np.unique(lists.label, return_inverse=True)[1]
            which = np.repeat(np.arange(len(lists.cuts) - 1), np.diff(lists.cuts))
            lab = lab + which * (len(lab) + 1)  # labels of one list only
            seen = np.zeros(int(ids.max(initial=-1)) + 1, bool)
            for i, j in lists.pairs():
                order = np.argsort(i, kind="stable")
                i, j = i[order], j[order]
                starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]])) if len(i) else np.zeros(1, np.int64)
                for a, z in zip(starts[:-1], starts[1:]):
                    one, many = int(i[a]), j[a:z]
                    many = many[lab[many] != lab[one]]
                    if not len(many):
                        continue
                    own = ids[begin[one] : begin[one + 1]]
                    seen[own] = True
                    n = sizes[many]
                    before = np.concatenate([[0], np.cumsum(n)])
                    hit = seen[ids[np.repeat(begin[many] - before[:-1], n) + np.arange(before[-1])]]
                    both = np.add.reduceat(hit.astype(np.int64), before[:-1]) if before[-1] else np.zeros(len(many), np.int64)
                    seen[own] = False
                    linked = many[(both > 0) & (plan.den * both >= plan.num * (len(own) + n - both))]
                    lo, hi = lists.cuts[which[one]], lists.cuts[which[one] + 1]
                    for m in linked:
                        if lab[m] != lab[one]:
                            edges.append((min(lists.doc[one], lists.doc[m]), max(lists.doc[one], lists.doc[m])))
                            lab[lo:hi][lab[lo:hi] == lab[m]] = lab[one]
            out = np.array(edges, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return forest


# Lists as tables.

_COLUMNS = ["lid", "c0", "c1", "doc_id", "d1", "n_shingles", "label", "part", "sig"]


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition("lid").sortWithinPartitions("lid")


def _by_list(rows: DataFrame, fat: DataFrame) -> DataFrame:
    """``rows`` with lists of too many shingles dealt to pairs of their blocks."""
    blocks, own = F.coalesce("blocks", F.lit(1)), F.pmod(F.xxhash64("doc_id"), F.coalesce("blocks", F.lit(1)))
    dealt = rows.join(small(fat), rows["lid"] == fat["fat"], "left").withColumn("own_block", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    pair = F.xxhash64("lid", F.least("own_block", "other"), F.greatest("own_block", "other"))
    return dealt.withColumn("lid", F.when(blocks == 1, F.col("lid")).otherwise(pair)).drop("fat", "blocks", "own_block", "other")


def _edges(lists: DataFrame, sets_of: Callable[[DataFrame], DataFrame], plan: Plan) -> DataFrame:
    schema = lists.select(_COLUMNS).schema
    found = materialise(_dealt(lists.select(_COLUMNS)).mapInArrow(_collide(plan), schema))
    ids = materialise(found.select("doc_id").distinct())
    sets = materialise(sets_of(ids).select(F.col("id").alias("sid"), F.col("d1").alias("sd"), "own"))
    same = (F.col("doc_id") == F.col("sid")) & (F.col("d1") == F.col("sd"))
    weight = found.join(sets.select("sid", "sd", F.octet_length("own").alias("bytes")), same).groupBy("lid").agg(F.sum("bytes").alias("bytes"))
    fat = materialise(weight.where(F.col("bytes") > 8 * LIST_SHINGLES).select(F.col("lid").alias("fat"), (2 * F.ceil(F.col("bytes") / (8 * LIST_SHINGLES))).alias("blocks")))
    dealt = _by_list(found, fat) if fat.limit(1).count() else found
    edges = materialise(_dealt(dealt.join(sets, same).select(*_COLUMNS, "own")).mapInArrow(_forest(plan), "a long, b long").distinct())
    drop(found, ids, sets, fat)
    return edges


def posted(reps: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, p1, c0, key): ``reps`` (doc_id, d1, sig) under each of their signatures' heads."""
    at = F.explode(F.sequence(F.lit(0), F.lit(plan.heads - 1)))
    return reps.select("doc_id", F.col("d1").alias("p1"), "sig", at.alias("c0")).select("doc_id", "p1", "c0", F.xxhash64("c0", F.substring(F.col("sig"), 4 * F.col("c0") + 1, F.lit(4))).alias("key"))


def linked(posts: DataFrame, payload_of: Callable[[DataFrame], DataFrame], sets_of: Callable[[DataFrame], DataFrame], plan: Plan, block: int = BLOCK) -> DataFrame:
    """(node, root) of all posted nodes that are linked with another one; root is the smallest doc_id reachable.

    ``posts`` are (doc_id, p1, c0, key), repeated rows allowed; a pair counts in the list of its first equal head only, or in
    every list where c0 is -1. For a table of doc_ids, ``payload_of`` gives (doc_id, d1, n_shingles, sig) and ``sets_of`` gives
    (id, d1, own): the shingles as sorted distinct 64-bit hashes. Two sets are linked when den * intersection >=
    num * union. Several sets under one doc_id (told apart by d1, p1 in ``posts``) are one node.
    """
    coordinates = lambda: F.explode(F.sequence(F.lit(0), F.lit(plan.heads - 1)))
    several = posts.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")
    several = materialise(several)
    met = materialise(posts.join(small(several, BROADCAST_NUMBERS), "key").distinct())
    sizes = materialise(met.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > block))
    ids = materialise(met.select("doc_id").distinct())
    payload = payload_of(ids).withColumnRenamed("doc_id", "d")
    lists = met.join(payload, (F.col("doc_id") == F.col("d")) & (F.col("p1") == F.col("d1"))).drop("d", "p1").withColumn("c1", F.lit(-1)).withColumn("label", F.col("doc_id")).withColumn("part", F.lit(_PART_BOTH))
    if sizes.limit(1).count() == 0:
        edges = _edges(lists.withColumn("lid", F.col("key")), sets_of, plan)
        drop(several, met, sizes, ids)
        return components(edges)

    hot = small(sizes)
    whole = lists.join(hot, "key", "left_anti").withColumn("lid", F.col("key"))
    value = F.substring(F.col("sig"), 4 * plan.heads + F.col("c1") + 1, F.lit(1))
    again = lists.join(hot, "key", "left_semi").drop("c1").withColumn("c1", coordinates()).withColumn("key", F.xxhash64("key", "c1", value))
    counts = materialise(again.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    again = materialise(again.join(small(counts), "key"))
    blocks = F.ceil(F.col("members") / block)
    own = F.when(blocks > 1, F.xxhash64("key", F.pmod(F.xxhash64("doc_id"), blocks))).otherwise(F.col("key"))
    edges = _edges(whole.select(_COLUMNS).unionByName(again.withColumn("lid", own).select(_COLUMNS)), sets_of, plan)
    drop(several, met, ids, sizes, counts)
    roots = components(edges)

    cut = again.where(F.col("members") > block).drop("label").join(roots, F.col("doc_id") == F.col("node"), "left").withColumn("label", F.coalesce("root", "doc_id")).drop("node", "root")
    cut = materialise(cut)
    drop(again)
    main = cut.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label"))["label"].alias("main"))
    cut = cut.join(small(materialise(main)), "key")
    apart = cut.where("label <> main")
    if apart.limit(1).count() == 0:
        return roots
    lid = lambda b: F.xxhash64("key", b)
    members = cut.withColumn("part", F.lit(_PART_MEMBER)).withColumn("lid", lid(F.pmod(F.xxhash64("doc_id"), blocks)))
    probes = apart.withColumn("part", F.lit(_PART_PROBE)).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumn("lid", lid(F.col("b")))
    more = _edges(members.select(_COLUMNS).unionByName(probes.select(_COLUMNS)), sets_of, plan)
    if more.limit(1).count() == 0:
        return roots
    drop(roots)
    return components(edges.unionByName(more))
