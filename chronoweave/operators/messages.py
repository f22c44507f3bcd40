"""Lines to messages: recognise datetimes, repair years and uptimes, group lines, mark the merge order.

The lines of a block (a split of a file) come to a task together and in order, so a block is grouped where it was
read: no line is shuffled. What a block needs to know of the file's other blocks is a few numbers:
how many messages precede it, the latest datetime before it, how many turns of a year follow it, the file's last
uptime, and the undated lines at the beginning of the blocks after it. A first pass gives one row of them
for each block; files that are one block need no such pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions import patterns
from chronoweave.plans.shared import written

NANOS = 1_000_000_000
_JUMP = 25 * 3600 * NANOS
_DAY = 86400 * NANOS
_NONE = np.iinfo(np.int64).min

MESSAGES = (
    "path_id int, seq long, epoch_ns long, tz_offset_s int, pattern_id int, dt_beg int, dt_end int, n_lines long, merge_key long, inside boolean, raw binary"
)
_ARROW = pa.schema(
    [("path_id", pa.int32()), ("seq", pa.int64()), ("epoch_ns", pa.int64()), ("tz_offset_s", pa.int32()), ("pattern_id", pa.int32()), ("dt_beg", pa.int32()), ("dt_end", pa.int32()),
     ("n_lines", pa.int64()), ("merge_key", pa.int64()), ("inside", pa.bool_()), ("raw", pa.binary())]
)
#: One row for each block: what the other blocks of its file may need.
STATS = "path_id int, block long, first_ns long, last_ns long, turns long, uptime long, n long, high long, past boolean, orphan binary, orphan_lines long"


@dataclass(frozen=True)
class Grouping:
    """Zone of datetimes without one, clock quirk of uptimes, and the window.

    ``ordering="compat"`` ends a file at its first message past ``before``; ``flag`` keeps the messages outside, too, and
    tells them apart by ``inside``.
    """

    default_tz: int = 0
    compat_epoch: bool = False
    after: int | None = None
    before: int | None = None
    ordering: str = "strict"
    flag: bool = False


def with_datetimes(lines: DataFrame, default_tz: int, compat_epoch: bool = False, allowed: str | None = None) -> DataFrame:
    """Adds the fields of :func:`patterns.fields` to every line; null where a line holds no datetime."""
    return patterns.stamped(lines, F.col("raw").cast("string"), F.lit(default_tz), F.col(allowed) if allowed else None, compat_epoch)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks: the rows of one block follow one another, maybe over several batches."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        path, block = b.column("path_id").to_numpy(), b.column("block").to_numpy()
        cuts = np.flatnonzero((path[1:] != path[:-1]) | (block[1:] != block[:-1])) + 1
        if rest and (rest[-1].column("path_id")[-1].as_py(), rest[-1].column("block")[-1].as_py()) != (path[0], block[0]):
            yield pa.Table.from_batches(rest).combine_chunks()
            rest = []
        for a, z in zip([0, *cuts], cuts):
            yield pa.Table.from_batches([*rest, b.slice(a, z - a)]).combine_chunks()
            rest = []
        rest.append(b.slice(cuts[-1] if len(cuts) else 0))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _column(table: pa.Table, name: str, missing) -> np.ndarray:
    return table.column(name).combine_chunks().fill_null(missing).to_numpy(zero_copy_only=False)


def _first(table: pa.Table, name: str):
    return table.column(name)[0].as_py() if name in table.column_names else None


def in_year(epoch_ns: np.ndarray, zone_s: np.ndarray, year: np.ndarray) -> np.ndarray:
    """The instants with the wall clock of ``epoch_ns`` in another year; ``_NONE`` where that day isn't in it."""
    wall = epoch_ns + zone_s * NANOS
    day = np.floor_divide(wall, _DAY)
    date = day.astype("datetime64[D]")
    month = date.astype("datetime64[M]")
    number, of_month = month.astype(np.int64) % 12, (date - month).astype(np.int64)
    moved = ((year - 1970) * 12 + number).astype("datetime64[M]")
    new = moved.astype("datetime64[D]") + of_month
    return np.where(new.astype("datetime64[M]") == moved, new.astype(np.int64) * _DAY + (wall - day * _DAY) - zone_s * NANOS, _NONE)


def _repaired(table: pa.Table, how: Grouping) -> tuple[np.ndarray, int, int, int, int]:
    """Instants of a block's lines (``_NONE`` without one), then its stats: first and last without year, turns, last uptime."""
    epoch, zone = _column(table, "epoch_ns", _NONE), _column(table, "tz_offset_s", 0).astype(np.int64)
    dated, uptime = epoch != _NONE, _column(table, "is_uptime", False)
    lacking = np.flatnonzero(dated & ~_column(table, "has_year", False) & ~uptime)
    first = last = up = _NONE
    turns = 0
    if len(lacking):
        own = epoch[lacking]
        first, last = int(own[0]), int(own[-1])
        jump = np.zeros(len(own), np.int64)
        jump[:-1] = own[:-1] - own[1:] > _JUMP
        turns = int(jump.sum())
        after = np.cumsum(jump[::-1])[::-1] + (_first(table, "turns_after") or 0)
        mtime = _first(table, "mtime")
        at = np.datetime64(int(np.floor(mtime)) + how.default_tz, "s").astype("datetime64[Y]").astype(np.int64) + 1970
        epoch = epoch.copy()
        epoch[lacking] = in_year(own, zone[lacking], at - after)
    ups = np.flatnonzero(dated & uptime)
    if len(ups):
        up = int(epoch[ups[-1]])
        end = _first(table, "last_uptime")
        end = up if end is None else end
        zero = int(np.floor(_first(table, "mtime"))) - (how.default_tz if how.compat_epoch else 0) - end // NANOS
        epoch = epoch.copy()
        epoch[ups] += zero * NANOS
    return epoch, first, last, turns, up


def _stats(how: Grouping):
    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            epoch, first, last, turns, up = _repaired(table, how)
            starts = np.flatnonzero(epoch != _NONE)
            lead = int(starts[0]) if len(starts) else len(epoch)
            raw = b"".join(x.as_py() for x in table.column("raw").slice(0, lead))
            if lead == len(epoch) and _first(table, "open_end"):
                raw = raw[:-1]
            high = int(epoch[starts].max()) if len(starts) else _NONE
            known = lambda x: None if x == _NONE else x
            row = [_first(table, "path_id"), _first(table, "block"), known(first), known(last), turns, known(up), len(starts), known(high)]
            past = bool(how.before is not None and len(starts) and high > how.before)
            kinds = [pa.int32(), *[pa.int64()] * 7, pa.bool_(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*row, past, raw, lead], kinds)], names=[c.split()[0] for c in STATS.split(", ")])

    return stats


def _group(how: Grouping):
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            epoch, *_ = _repaired(table, how)
            starts = np.flatnonzero(epoch != _NONE)
            if not len(starts):
                continue
            raw = table.column("raw").combine_chunks()
            _, offsets, data = raw.buffers()
            at = np.frombuffer(offsets, np.int32)[raw.offset : raw.offset + len(raw) + 1]
            cuts = np.append(starts, len(epoch))
            bounds = np.ascontiguousarray(at[cuts])
            joined = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), data])
            n_lines = np.diff(cuts)
            tail, strip = _first(table, "tail") or b"", bool(_first(table, "open_end"))
            if tail or strip:
                n_lines[-1] += _first(table, "tail_lines") or 0
                last = joined[-1].as_py()
                joined = pa.concat_arrays([joined.slice(0, len(starts) - 1), pa.array([(last[:-1] if strip else last) + tail], pa.binary())])
            key = np.maximum.accumulate(epoch[starts])
            if (high := _first(table, "high_before")) is not None:
                key = np.maximum(key, high)
            keep = epoch[starts] >= how.after if how.after is not None else np.ones(len(starts), bool)
            if how.ordering == "compat":
                keep &= not _first(table, "past_before")
                # the reader begins at the first message inside, so only what comes after it ends the file
                keep &= np.maximum.accumulate(np.where(keep, epoch[starts], _NONE)) <= how.before if how.before is not None else True
            elif how.before is not None:
                keep &= epoch[starts] <= how.before
            seq = (_first(table, "n_before") or 0) + np.arange(1, len(starts) + 1)
            of = lambda name: table.column(name).combine_chunks().take(pa.array(starts))
            columns = [of("path_id"), pa.array(seq), pa.array(epoch[starts]), *(of(c) for c in ("tz_offset_s", "pattern_id", "dt_beg", "dt_end")), pa.array(n_lines), pa.array(key), pa.array(keep), joined]
            made = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
            yield made if how.flag else made.filter(pa.array(keep))

    return group


def block_stats(stamped: DataFrame, how: Grouping = Grouping()) -> DataFrame:
    """One row (``STATS``) for each block of ``stamped`` lines."""
    return stamped.mapInArrow(_stats(how), STATS)


def _by_block(backwards: bool = False):
    return Window.partitionBy("path_id").orderBy(F.col("block").desc() if backwards else F.col("block"))


def turns_after(stats: DataFrame) -> DataFrame:
    """path_id, block, turns_after, last_uptime: what repairs years and uptimes, from the blocks after each."""
    later = _by_block(True).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.last("first_ns", ignorenulls=True).over(later)
    own = stats.withColumn("own", F.col("turns") + F.when(F.col("last_ns") - ahead > _JUMP, 1).otherwise(0))
    # the turn between this block's last datetime and the next one's first belongs to all of this block's lines
    between = F.col("own") - F.col("turns")
    up = F.max_by("uptime", F.when(F.col("uptime").isNotNull(), F.col("block"))).over(Window.partitionBy("path_id"))
    return own.select("path_id", "block", (F.coalesce(F.sum("own").over(later), F.lit(0)) + between).alias("turns_after"), up.alias("last_uptime"))


def bases(stats: DataFrame) -> DataFrame:
    """path_id, block, n_before, high_before, past_before, tail, tail_lines: what orders and completes messages."""
    before = _by_block().rowsBetween(Window.unboundedPreceding, -1)
    group = F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(_by_block())
    rows = stats.withColumn("g", group)
    tails = rows.where("n = 0 or orphan_lines > 0").select("path_id", "block", F.when(F.col("n") > 0, F.col("g") - 1).otherwise(F.col("g")).alias("g"), "orphan", "orphan_lines")
    tails = tails.groupBy("path_id", "g").agg(F.array_sort(F.collect_list(F.struct("block", "orphan"))).alias("t"), F.sum("orphan_lines").alias("tail_lines"))
    joined = F.aggregate("t", F.lit(b""), lambda a, x: F.concat(a, x["orphan"]))
    tails = tails.select(F.col("path_id").alias("tp"), F.col("g").alias("tg"), joined.alias("tail"), "tail_lines")
    own = rows.select(
        "path_id", "block", "g", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.max("high").over(before).alias("high_before"),
        F.coalesce(F.max("past").over(before), F.lit(False)).alias("past_before"),
    )
    on = (F.col("path_id") == F.col("tp")) & (F.col("g") == F.col("tg")) & (F.col("n") > 0)
    return own.join(tails, on, "left").select("path_id", "block", "n_before", "high_before", "past_before", "tail", F.coalesce("tail_lines", F.lit(0)).alias("tail_lines"))


def grouped(stamped: DataFrame, how: Grouping = Grouping()) -> DataFrame:
    """Messages (``MESSAGES``) of ``stamped`` lines inside the window.

    A line with a datetime begins a message, other lines join the one before; leading ones go. Inside one
    common year, a step back of more than 25 hours to the next datetime without year is a turn of the year; the
    last one has the year of the file's ``mtime`` (seconds). February 29 of a year without one is no
    datetime. The last uptime of a file is its mtime. The rows of one block follow one another in their
    order; the columns of :func:`turns_after` and :func:`bases`, if there, tell what the file's other blocks add. merge_key is the latest datetime of the file so far.
    """
    return stamped.mapInArrow(_group(how), MESSAGES)


def in_blocks(lines: DataFrame, order: str = "pos") -> DataFrame:
    """Lines of a table (path_id, block, ...) put into the order that :func:`grouped` reads."""
    return lines.repartition("path_id", "block").sortWithinPartitions("path_id", "block", order)


def all_grouped(stamped: DataFrame, how: Grouping = Grouping(), order: str = "pos") -> DataFrame:
    """Messages of a table's lines (path_id, block, ``order``, ...), in blocks of any number: :func:`grouped` after two passes for what the blocks need of each other.

    The recognised lines are written once, so that the passes over them don't recognise again; without a datetime that lacks its
    year there is one pass less. They are put in order last before each pass: the optimiser takes a sort away that lies
    below a join.
    """
    stamped = written(stamped)
    if stamped.where("epoch_ns is not null and not has_year").limit(1).count():
        stamped = attached(stamped, turns_after(block_stats(in_blocks(stamped, order), how)))
    complete = attached(stamped, bases(block_stats(in_blocks(stamped, order), how)))
    return grouped(in_blocks(complete, order), how)


def attached(stamped: DataFrame, base: DataFrame) -> DataFrame:
    """``stamped`` with the columns that ``base`` has for its block, the order of the lines unchanged.

    ``base`` has a row for each split of the files, as the list of files has, so it is broadcast.
    """
    base = base.withColumnsRenamed({"path_id": "_p", "block": "_b"})
    return stamped.join(F.broadcast(base), (F.col("path_id") == F.col("_p")) & (F.col("block") == F.col("_b")), "left").drop("_p", "_b")
