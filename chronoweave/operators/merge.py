"""Datetime windows and the merge of sources into one order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.running import with_running
from chronoweave.plans.shared import written

#: Messages per block of a running maximum.
BLOCK = 1 << 20


def in_window(messages: DataFrame, after: int | None, before: int | None, ordering: str = "strict", at: str = "epoch_ns", seq: str = "seq") -> DataFrame:
    """Messages from ``after`` to ``before``, both included.

    ``ordering="compat"`` ends a source at its first message past ``before``, as a reader that
    trusts the order of a file does.
    """
    if after is not None:
        messages = messages.where(F.col(at) >= after)
    if before is None:
        return messages
    if ordering == "strict":
        return messages.where(F.col(at) <= before)
    blocked = messages.withColumn("_block", F.floor(F.col(seq) / BLOCK))
    past = F.when(F.col(at) > before, 1).otherwise(0)
    return with_running(blocked, ["path_id"], "_block", seq, {"_past": ("max", past)}).where("_past = 0").drop("_past", "_block")


def with_merge_key(messages: DataFrame, at: str = "epoch_ns", seq: str = "seq", block: int = BLOCK) -> DataFrame:
    """Adds merge_key: the latest datetime of a source so far.

    Ordering by (merge_key, path_id, seq) is exactly what comes from always taking the earliest of
    the sources' next messages, whether or not a source is in order.
    """
    blocked = messages.withColumn("_block", F.floor(F.col(seq) / block))
    return with_running(blocked, ["path_id"], "_block", seq, {"merge_key": ("max", F.col(at))}).drop("_block")


def last_of_each_time(messages: DataFrame, at: str = "epoch_ns") -> DataFrame:
    """Of a source's messages with one time, the last (largest seq); others give way to it. Partial aggregation, then a row per time."""
    return messages.groupBy("path_id", at).agg(F.max_by(F.struct(*messages.columns), "seq").alias("m")).select("m.*")


def with_position(messages: DataFrame, at: str = "merge_key") -> DataFrame:
    """Adds position, from 1: the place of each message in the merged order.

    Messages are ranked inside ranges of the order and the ranges' sizes are summed up, so no task holds all rows. They
    are written with their range and rank: a plan that made the ranges once to count and once to number
    them could cut them differently.
    """
    ranges = messages.repartitionByRange(at, "path_id", "seq").sortWithinPartitions(at, "path_id", "seq")
    # one number for each row of its own range, then one row for each range
    numbered = ranges.withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = written(numbered.withColumn("_part", part).withColumn("_place", place))
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return numbered.join(F.broadcast(starts), F.col("_part") == F.col("_p")).withColumn("position", F.col("_start") + F.col("_place") + 1).drop("_id", "_part", "_place", "_p", "_start")


def merged(messages: DataFrame, at: str = "epoch_ns", seq: str = "seq") -> DataFrame:
    return with_merge_key(messages, at, seq).orderBy("merge_key", "path_id", seq)
