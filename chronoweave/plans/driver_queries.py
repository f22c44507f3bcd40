"""Queries over the given tables read as message sources, each with its equivalent SQL.

A source is a table with a datetime; ``events``, ``orders`` and ``lineitem`` are sources 0 to 2. Messages are
ordered by the merge key of their source (its latest datetime so far), then source, then place in the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import merge, render

_ZERO = "1970-01-01 00:00:00"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_id, seq, epoch_ns, text of the three sources; each scan reads only the columns it needs."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nanos = lambda c: F.timestamp_diff("MICROSECOND", F.lit(_ZERO).cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz")) * 1000
    events = read("events").select(F.lit(0).alias("path_id"), F.col("event_id").alias("seq"), nanos("ts").alias("epoch_ns"), F.col("event_type").alias("text"))
    orders = read("orders").select(F.lit(1).alias("path_id"), F.col("o_orderkey").alias("seq"), nanos("o_orderdate").alias("epoch_ns"), F.col("o_orderpriority").alias("text"))
    lines = read("lineitem").select(
        F.lit(2).alias("path_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), nanos("l_shipdate").alias("epoch_ns"), F.col("l_returnflag").alias("text")
    )
    return events.unionByName(orders).unionByName(lines)


_MESSAGES = """(SELECT path_id, seq, epoch_us(CAST(dt AS TIMESTAMP)) * 1000 AS epoch_ns, text FROM (SELECT 0 AS path_id, event_id AS seq, ts AS dt, event_type AS text FROM events
 UNION ALL SELECT 1, o_orderkey, o_orderdate, o_orderpriority FROM orders
 UNION ALL SELECT 2, l_orderkey * 10 + l_linenumber, l_shipdate, l_returnflag FROM lineitem)) m"""
#: 2024-01-05 and 2024-01-20, midnight.
AFTER, BEFORE = 1704412800 * 10**9, 1705708800 * 10**9


def filter_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.in_window(messages(spark, sf_dir), AFTER, None).select("path_id", "seq", "text")


def filter_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.in_window(messages(spark, sf_dir), None, BEFORE).select("path_id", "seq", "text")


def filter_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.in_window(messages(spark, sf_dir), AFTER, BEFORE).select("path_id", "seq", "text")


def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, bytes, first and last datetime of each source and of all."""
    rows = messages(spark, sf_dir).select("path_id", "epoch_ns", F.lit(1).cast("bigint").alias("n_lines"), F.col("text").cast("binary").alias("raw"))
    return render.summary(rows).select("path_id", "n_messages", "n_bytes", "first_ns", "last_ns")


def merge_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages inside the window with their place in the merged order, each with source and UTC datetime in front."""
    inside = merge.with_merge_key(merge.in_window(messages(spark, sf_dir), AFTER, BEFORE))
    rows = inside.select("path_id", "seq", "epoch_ns", "merge_key", F.lit(0).alias("tz_offset_s"), F.concat(F.col("text"), F.lit("\n")).cast("binary").alias("raw"))
    out = render.rendered(merge.with_position(rows), F.col("path_id").cast("string"), "%Y%m%dT%H%M%S", "+00:00")
    return out.select("path_id", "seq", F.col("position").cast("bigint").alias("position"), F.col("text").alias("line"))


QUERIES = {f.__name__: f for f in (filter_after, filter_before, filter_between, source_summary, merge_rendered)}
ORACLE_SQL = {
    "filter_after": f"SELECT path_id, seq, text FROM {_MESSAGES} WHERE epoch_ns >= {AFTER}",
    "filter_before": f"SELECT path_id, seq, text FROM {_MESSAGES} WHERE epoch_ns <= {BEFORE}",
    "filter_between": f"SELECT path_id, seq, text FROM {_MESSAGES} WHERE epoch_ns BETWEEN {AFTER} AND {BEFORE}",
    "source_summary": f"SELECT path_id, count(*) AS n_messages, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, min(epoch_ns) AS first_ns, max(epoch_ns) AS last_ns FROM {_MESSAGES} GROUP BY ROLLUP (path_id)",
    "merge_rendered": f"""WITH k AS (SELECT *, max(epoch_ns) OVER (PARTITION BY path_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS merge_key FROM {_MESSAGES} WHERE epoch_ns BETWEEN {AFTER} AND {BEFORE})
 SELECT path_id, seq, row_number() OVER (ORDER BY merge_key, path_id, seq) AS position,
 concat(path_id, ':', strftime(make_timestamp(epoch_ns // 1000), '%Y%m%dT%H%M%S'), ':', text, chr(10)) AS line FROM k""",
}
