"""One query per operator over the given tables, each with its equivalent SQL.

``events`` split by type are four sources with datetimes shifted by ``event_id % 7`` hours, so that
sources are out of order. Parsing queries render ``events.ts`` to text in some log format and give
the instants that recognition finds in it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import patterns
from chronoweave.operators import journal, merge, messages, render
from chronoweave.operators.running import with_next, with_running
from chronoweave.plans import logs
from chronoweave.plans.shared import shared_path
from chronoweave.sources import files

NANOS = 1_000_000_000
_TYPES = "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END"
_SHIFTED = f"(SELECT {_TYPES} AS path_id, event_id AS seq, epoch_us(ts) // 1000000 * 1000000000 - event_id % 7 * 3600000000000 AS epoch_ns, event_type AS text FROM events)"
_START = 1704067200 * NANOS
_AFTER, _BEFORE = _START + 4 * 86400 * NANOS, _START + 19 * 86400 * NANOS


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _seconds(ts: Column) -> Column:
    """Epoch seconds of a datetime without zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("second", ts).cast("timestamp_ntz"))


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = _seconds(F.col("ts")) - F.col("event_id") % 7 * 3600
    return _events(spark, sf_dir).select(
        F.expr(_TYPES).alias("path_id"), F.col("event_id").alias("seq"), (seconds * NANOS).alias("epoch_ns"), F.col("event_type").alias("text")
    )


def merge_kway(spark, sf_dir):
    return merge.with_merge_key(_shifted(spark, sf_dir)).select("path_id", "seq", "merge_key")


def filter_takewhile(spark, sf_dir):
    return merge.in_window(_shifted(spark, sf_dir), _AFTER, _BEFORE, "compat").select("path_id", "seq", "epoch_ns")


def filter_strict_shifted(spark, sf_dir):
    return merge.in_window(_shifted(spark, sf_dir), _AFTER, _BEFORE).select("path_id", "seq", "epoch_ns")


def out_of_order_count(spark, sf_dir):
    blocked = _shifted(spark, sf_dir).withColumn("_block", F.floor(F.col("seq") / merge.BLOCK))
    ahead = with_next(blocked, ["path_id"], "_block", "seq", "after", F.col("epoch_ns"))
    return ahead.groupBy("path_id").agg(F.sum(F.when(F.col("after") < F.col("epoch_ns"), 1).otherwise(0)).cast("bigint").alias("n_late"))


def merge_position(spark, sf_dir):
    keyed = merge.with_merge_key(_shifted(spark, sf_dir))
    return merge.with_position(keyed).select("path_id", "seq", F.col("position").cast("bigint").alias("position"))


def dedup_time_last_wins(spark, sf_dir):
    hour = F.floor(F.col("epoch_ns") / (3600 * NANOS)).cast("bigint")
    return merge.last_of_each_time(_shifted(spark, sf_dir).withColumn("hour", hour), "hour").select("path_id", "hour", "seq")


def processed_vs_accepted(spark, sf_dir):
    rows = _shifted(spark, sf_dir).withColumn("raw", F.col("text").cast("binary"))
    return render.accepted(rows, F.col("epoch_ns").between(_AFTER, _BEFORE))


def _parsed(spark, sf_dir, line: Column, default_tz: int = 0) -> DataFrame:
    read = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), line.alias("line"))
    return patterns.stamped(read, F.col("line"), F.lit(default_tz)).select("seq", "epoch_ns")


def _fmt(form: str) -> Column:
    return F.date_format("ts", form)


def parse_iso(spark, sf_dir):
    return _parsed(spark, sf_dir, F.concat(_fmt("yyyy-MM-dd'T'HH:mm:ss"), F.lit(" "), F.col("event_type")))


def parse_apache(spark, sf_dir):
    return _parsed(spark, sf_dir, F.concat(F.lit("10.0.0.1 - - ["), _fmt("dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0130] "GET /"')))


def parse_rfc2822(spark, sf_dir):
    return _parsed(spark, sf_dir, F.concat(F.lit("Date: "), _fmt("EEE, d MMM yyyy HH:mm:ss"), F.lit(" EDT x")))


def parse_ctime(spark, sf_dir):
    return _parsed(spark, sf_dir, F.concat(_fmt("EEE MMM dd HH:mm:ss yyyy"), F.lit(" x")))


def parse_epoch(spark, sf_dir):
    return _parsed(spark, sf_dir, F.concat(_seconds(F.col("ts")).cast("string"), F.lit(".250 x")))


def parse_epoch_ms(spark, sf_dir):
    return _parsed(spark, sf_dir, F.concat(F.lit('{"timestamp": '), (_seconds(F.col("ts")) * 1000 + F.col("event_id") % 1000).cast("string"), F.lit(", }")))


def parse_2digit_year(spark, sf_dir):
    return _parsed(spark, sf_dir, F.concat(F.lit("["), _fmt("dd-MMM-yy HH:mm:ss"), F.lit("] x")))


def parse_fraction(spark, sf_dir):
    return _parsed(spark, sf_dir, F.concat(_fmt("yyyy/MM/dd HH:mm:ss"), F.lit(","), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit("987 x")))


def tz_named(spark, sf_dir):
    return _parsed(spark, sf_dir, F.concat(_fmt("yyyy-MM-dd HH:mm:ss"), F.lit(" NPT x")))


def tz_ambiguous_default(spark, sf_dir):
    return _parsed(spark, sf_dir, F.concat(_fmt("yyyy-MM-dd HH:mm:ss"), F.lit(" IST x")), 8 * 3600)


#: Events of one block of a made file: small, so that files have several.
_BLOCK = 3000


def _file(spark, sf_dir, line: Column, mtime: int) -> DataFrame:
    """All events as the lines of one file per type, in blocks; lines end with the event's number."""
    return _events(spark, sf_dir).select(
        F.expr(_TYPES).alias("path_id"), F.floor(F.col("event_id") / _BLOCK).alias("block"), F.col("event_id").alias("pos"),
        F.lit(float(mtime)).alias("mtime"), F.concat(line, F.lit(" "), F.col("event_id").cast("string"), F.lit("\n")).cast("binary").alias("raw"),
    )


def _grouped(lines: DataFrame) -> DataFrame:
    return messages.all_grouped(messages.with_datetimes(lines, 0))


def _number(raw: str = "raw") -> Column:
    """The event's number at the end of a message's first line."""
    return F.regexp_extract(F.col(raw).cast("string"), r"(\d+)\n", 1).cast("bigint")


def infer_year(spark, sf_dir):
    """Datetimes stretched over years, their year left out, found again from an mtime at the end of 2031."""
    stretched = F.timestamp_add("HOUR", (F.col("event_id") * 7).cast("int"), F.lit("2001-01-01 00:00:00").cast("timestamp_ntz"))
    found = _grouped(_file(spark, sf_dir, F.concat(F.date_format(stretched, "MMM dd HH:mm:ss"), F.lit(" host")), 1956527999))
    return found.select("path_id", _number().alias("seq"), "epoch_ns")


def anchor_uptime(spark, sf_dir):
    found = _grouped(_file(spark, sf_dir, F.concat(F.lit("[    "), F.col("event_id").cast("string"), F.lit(".250000] x")), 1700000000))
    return found.select("path_id", _number().alias("seq"), "epoch_ns")


def group_multiline(spark, sf_dir):
    """Turns as messages of several lines, blocks cut inside of them: a datetime line, then the text's own lines."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    head = F.concat(F.lit("2024-01-01 00:00:00 "), F.coalesce("role", F.lit("")))
    every = F.concat(F.array(head), F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("| "), x)))
    number = F.struct(F.coalesce("conv_id", F.lit(-1)).alias("c"), F.coalesce("turn", F.lit(-1)).alias("t"))
    parts = turns.select(number.alias("n"), F.posexplode(every))
    # files of a hundred conversations; a block ends within a message
    lines = parts.select(
        F.floor((F.col("n.c") + 1) / 100).cast("int").alias("path_id"), (F.col("n.c") * 1000 + F.col("n.t") * 2 + F.when(F.col("pos") > 1, 1).otherwise(0)).alias("block"), F.col("pos").cast("bigint").alias("pos"),
        F.concat("col", F.lit("\n")).cast("binary").alias("raw"),
    )
    return _grouped(lines).select("path_id", "seq", "n_lines", F.octet_length("raw").cast("bigint").alias("n_bytes"), F.md5("raw").alias("md5"))


def classify_path(spark, sf_dir):
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("", ".log", ".log.gz", ".wtmp.1", ".evtx.xz", ".tar")]), (F.col("page_id") % 6 + 1).cast("int"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.lit("dir/page"), F.col("page_id").cast("string"), suffix).alias("name"))
    return files.classified(pages).select("page_id", "file_type", "archive")


def _written_files(spark, sf_dir, line: Column, **options) -> list[str]:
    """Folders with one log file for each event type: the shifted events in order, every third with a second line."""
    path = shared_path(spark)
    _write_lines(_shown(spark, sf_dir), line, ["path_id"], path, **options)
    return [f"{path}/path_id={i}" for i in range(4)]


def _shown(spark, sf_dir) -> DataFrame:
    shown = F.timestamp_add("HOUR", -(F.col("event_id") % 7).cast("int"), F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return _events(spark, sf_dir).select(F.expr(_TYPES).alias("path_id"), "event_id", shown.alias("at"), "event_type")


def _write_lines(rows: DataFrame, line: Column, by: list[str], path: str, **options) -> None:
    text = F.concat(line, F.lit(" "), F.col("event_type"), F.lit(" "), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "\n  more").otherwise(""))
    ordered = rows.select(*by, "event_id", text.alias("value")).repartition(*by).sortWithinPartitions(*by, "event_id")
    # one file for each of ``by``: a session's limit of rows a file would cut it into several, each merged as a source of its own
    ordered.select(*by, "value").write.partitionBy(*by).options(maxRecordsPerFile=0, **options).text(path)


def _planned(spark, paths: list[str], **options) -> logs.Search:
    """A search of the written files for the messages in the window."""
    window = {"after": "2024-01-05 00:00:00", "before": "2024-01-20 00:00:00"}
    return logs.plan(spark, paths, logs.Options(dt_format="%Y%m%dT%H%M%S", dt_zone="+00:00", **window, **options))


def _placed(inside: DataFrame) -> DataFrame:
    """Position and text of messages."""
    return render.rendered(merge.with_position(inside), None, "%Y%m%dT%H%M%S", "+00:00").select("path_id", F.col("position").cast("bigint").alias("position"), "text")


def _searched(spark, sf_dir, paths: list[str], **options) -> DataFrame:
    return _placed(_planned(spark, paths, **options).messages())


def search_plain(spark, sf_dir):
    return _searched(spark, sf_dir, _written_files(spark, sf_dir, F.date_format("at", "yyyy-MM-dd HH:mm:ss")))


def search_gz(spark, sf_dir):
    return _searched(spark, sf_dir, _written_files(spark, sf_dir, F.date_format("at", "EEE MMM dd HH:mm:ss yyyy"), compression="gzip"))


def _rotated(spark, sf_dir) -> DataFrame:
    """The shifted events with the number of their file: a source begins another one before a step back of more than 25 hours."""
    rows = _shown(spark, sf_dir).withColumn("s", _seconds(F.col("at"))).withColumn("_block", F.floor(F.col("event_id") / merge.BLOCK))
    ahead = with_next(rows, ["path_id"], "_block", "event_id", "after", F.col("s"))
    ends = F.when(F.col("s") - F.col("after") > 25 * 3600, 1).otherwise(0)
    return with_running(ahead, ["path_id"], "_block", "event_id", {"ended": ("sum", ends)}).withColumn("file", F.col("ended") - ends)


def search_no_year(spark, sf_dir):
    """Lines without a year, in files that end before a step back that would read as the turn of a year; a file's mtime is its last line's.

    The files of one source are merged as one: its merge key runs on over them. The driver takes three numbers a file.
    """
    rows, path = _rotated(spark, sf_dir), shared_path(spark)
    _write_lines(rows, F.date_format("at", "MMM dd HH:mm:ss"), ["path_id", "file"], path)
    ends = rows.groupBy("path_id", "file").agg(F.max_by("s", "event_id").alias("s")).orderBy("path_id", "file").collect()
    found = _planned(spark, [f"{path}/path_id={r.path_id}/file={r.file}" for r in ends])
    found = replace(found, files=[f | {"mtime": float(r.s)} for f, r in zip(found.files, ends, strict=True)])
    highs = {r.path_id: r.high for r in found.messages(flag=True).groupBy("path_id").agg(F.max("merge_key").alias("high")).collect()}
    listed, before = [], {}
    for f, r in zip(found.files, ends):
        listed.append((f["path_id"], r.path_id, r.file, before.get(r.path_id)))
        before[r.path_id] = max((x for x in (before.get(r.path_id), highs.get(f["path_id"])) if x is not None), default=None)
    listed = spark.createDataFrame(listed, "_id int, _source int, _file long, _before long")
    inside = found.messages().join(F.broadcast(listed), F.col("path_id") == F.col("_id"))
    inside = inside.withColumns({"path_id": F.col("_source"), "seq": F.col("_file") * (1 << 32) + F.col("seq"), "merge_key": F.greatest("merge_key", "_before")})
    return _placed(inside.drop("_id", "_source", "_file", "_before"))


def search_takewhile(spark, sf_dir):
    return _searched(spark, sf_dir, _written_files(spark, sf_dir, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")), ordering="compat")


def _journal(spark, sf_dir) -> DataFrame:
    """Events as journal entries: every fifth without a process, every seventh without a name of its own."""
    text = lambda c: F.col(c).cast("string").cast("binary")
    field = lambda name, value, when=None: F.struct(F.lit(name).alias("k"), value.alias("v")) if when is None else F.when(when, F.struct(F.lit(name).alias("k"), value.alias("v")))
    fields = F.array_compact(F.array(
        field("_HOSTNAME", F.lit(b"host")), field("SYSLOG_IDENTIFIER", text("event_type"), F.col("event_id") % 7 != 0), field("_COMM", F.lit(b"comm")),
        field("_PID", text("user_id"), F.col("event_id") % 5 != 0), field("MESSAGE", F.concat(F.lit(b"event "), text("event_id"))), field("_SOURCE_REALTIME_TIMESTAMP", F.lit(b"1")), field("AAA", F.lit(b"x")),
    ))
    rows = _shifted(spark, sf_dir).select("path_id", "seq", (F.col("epoch_ns") / 1000).cast("bigint").alias("realtime_us"))
    rows = rows.join(_events(spark, sf_dir).select(F.col("event_id").alias("seq"), "event_id", "event_type", "user_id"), "seq")
    rows = rows.select("path_id", "seq", "realtime_us", (F.col("event_id") * 1_500_000).alias("monotonic_us"), F.concat(F.lit("s=0;i="), F.hex("event_id")).alias("cursor"), fields.alias("f"))
    made = rows.select("*", F.col("f.k").alias("keys"), F.col("f.v").alias("values"), F.col("realtime_us").alias("epoch_ns"))
    return merge.with_merge_key(made).withColumnRenamed("merge_key", "high_us")


def _journal_output(output: str):
    def query(spark, sf_dir):
        made = journal.journal_text(_journal(spark, sf_dir), output, 3600)
        return made.select("path_id", "seq", F.col("raw").cast("string").alias("text"), F.substr(F.col("raw").cast("string"), F.col("dt_beg") + 1, F.col("dt_end") - F.col("dt_beg")).alias("stamp"))

    return query


journal_short, journal_short_precise, journal_short_unix, journal_short_monotonic = (_journal_output(f"short{x}") for x in ("", "-iso-precise", "-unix", "-monotonic"))
journal_export, journal_verbose, journal_cat = (_journal_output(x) for x in ("export", "verbose", "cat"))


def journal_window(spark, sf_dir):
    """The exclusive upper end: a journal ends at its first entry at or past it."""
    return journal.in_journal_window(_journal(spark, sf_dir), _AFTER, _BEFORE, True).select("path_id", "seq", "realtime_us")


def prepend_all(spark, sf_dir):
    rows = _shifted(spark, sf_dir).select("path_id", "seq", "epoch_ns", F.lit(0).alias("tz_offset_s"), F.concat("text", F.lit("\nmore\n")).cast("binary").alias("raw"))
    name = F.concat(F.lit("src"), F.col("path_id").cast("string"))
    out = render.rendered(rows, name, "%Y%m%dT%H%M%S.%3f%z", "+05:30", "|", "--\\n")
    return out.select("path_id", "seq", "text")


def summary_total(spark, sf_dir):
    rows = _shifted(spark, sf_dir).select("path_id", "epoch_ns", F.lit(1).cast("bigint").alias("n_lines"), F.col("text").cast("binary").alias("raw"))
    return render.summary(rows)


def pattern_usage(spark, sf_dir):
    line = F.when(F.col("event_id") % 3 == 0, _fmt("yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, _fmt("EEE MMM dd HH:mm:ss yyyy")).otherwise(F.lit("no datetime"))
    names = F.create_map(*[F.lit(x) for f in patterns.FAMILIES for x in (f.id, f.name)])
    return render.pattern_counts(_grouped(_file(spark, sf_dir, line, 0))).select("path_id", F.try_element_at(names, F.col("pattern_id")).alias("pattern"), "n")


def evtx_timecreated(spark, sf_dir):
    xml = F.concat(F.lit('<Event><System><TimeCreated SystemTime="'), _fmt("yyyy-MM-dd'T'HH:mm:ss"), F.lit('.5Z"/></System></Event>'))
    at = F.concat(F.regexp_extract(xml, '<TimeCreated SystemTime="([^"]+)"', 1), F.lit(" "))
    return _parsed(spark, sf_dir, at)


def _parse_sql(nanos: str = "0") -> str:
    return f"SELECT event_id AS seq, epoch_us(ts) // 1000000 * 1000000000 + {nanos} AS epoch_ns FROM events"


_RUN = "OVER (PARTITION BY path_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"
_SHORT_TEXT = """stamp || ' host ' || CASE WHEN seq % 7 <> 0 THEN event_type ELSE 'comm' END || CASE WHEN seq % 5 <> 0 THEN '[' || user_id || ']' ELSE '' END || ': event ' || seq || chr(10)"""


def _journal_sql(stamp: str, text: str) -> str:
    return f"""SELECT path_id, seq, {text} AS text, stamp FROM (SELECT *, {stamp} AS stamp, 's=0;i=' || upper(printf('%x', seq)) AS cursor FROM
 (SELECT s.path_id, s.seq, s.epoch_ns, make_timestamp(s.epoch_ns // 1000 + 3600000000) AS t, e.event_type, e.user_id FROM {_SHIFTED} s JOIN events e ON e.event_id = s.seq))"""


def _search_sql(line: str, inside: str | None = None, after: str = "TRUE") -> str:
    stamp = "strftime(t, '%Y%m%dT%H%M%S')"
    return f"""WITH a AS (SELECT *, make_timestamp(epoch_ns // 1000) AS t, max(epoch_ns) {_RUN} AS k FROM {_SHIFTED}),
 b AS (SELECT *, max(epoch_ns) {_RUN} AS k2 FROM a WHERE {inside or f'epoch_ns BETWEEN {_AFTER} AND {_BEFORE}'})
 SELECT path_id, row_number() OVER (ORDER BY k, path_id, seq) AS position,
 {stamp} || ':' || {line} || ' ' || text || ' ' || seq || chr(10) || CASE WHEN seq % 3 = 0 THEN {stamp} || ':  more' || chr(10) ELSE '' END AS text FROM b WHERE {after}"""


ORACLE_SQL = {
    "merge_kway": f"SELECT path_id, seq, max(epoch_ns) {_RUN} AS merge_key FROM {_SHIFTED}",
    "filter_takewhile": f"SELECT path_id, seq, epoch_ns FROM (SELECT *, max(epoch_ns) {_RUN} AS k FROM {_SHIFTED} WHERE epoch_ns >= {_AFTER}) WHERE k <= {_BEFORE}",
    "filter_strict_shifted": f"SELECT path_id, seq, epoch_ns FROM {_SHIFTED} WHERE epoch_ns BETWEEN {_AFTER} AND {_BEFORE}",
    "out_of_order_count": "SELECT path_id, CAST(sum(CASE WHEN a < epoch_ns THEN 1 ELSE 0 END) AS BIGINT) AS n_late FROM"
    f" (SELECT *, lead(epoch_ns) OVER (PARTITION BY path_id ORDER BY seq) AS a FROM {_SHIFTED}) GROUP BY path_id",
    "dedup_time_last_wins": f"SELECT path_id, epoch_ns // 3600000000000 AS hour, max(seq) AS seq FROM {_SHIFTED} GROUP BY ALL",
    "parse_iso": _parse_sql(),
    "parse_apache": _parse_sql("-5400000000000"),
    "parse_rfc2822": _parse_sql("14400000000000"),
    "parse_ctime": _parse_sql(),
    "parse_epoch": _parse_sql("250000000"),
    "parse_epoch_ms": _parse_sql("event_id % 1000 * 1000000"),
    "parse_2digit_year": _parse_sql(),
    "parse_fraction": _parse_sql("event_id % 1000 * 1000000 + 987000"),
    "tz_named": _parse_sql("-20700000000000"),
    "tz_ambiguous_default": _parse_sql("-28800000000000"),
    "evtx_timecreated": _parse_sql("500000000"),
    "infer_year": f"""WITH a AS (SELECT {_TYPES} AS path_id, event_id AS seq, TIMESTAMP '2001-01-01' + to_hours(CAST(event_id * 7 AS INTEGER)) AS t FROM events),
 b AS (SELECT *, make_timestamp(1972, month(t), day(t), hour(t), minute(t), second(t)) AS md FROM a),
 c AS (SELECT *, CASE WHEN md - lead(md) OVER (PARTITION BY path_id ORDER BY seq) > INTERVAL 25 HOURS THEN 1 ELSE 0 END AS r FROM b),
 d AS (SELECT *, 2031 - sum(r) OVER (PARTITION BY path_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS y FROM c)
 SELECT path_id, seq, epoch_us(make_timestamp(CAST(y AS BIGINT), month(t), day(t), hour(t), minute(t), second(t))) * 1000 AS epoch_ns FROM d
 WHERE NOT (month(t) = 2 AND day(t) = 29) OR (y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0))""",
    "anchor_uptime": f"SELECT {_TYPES} AS path_id, event_id AS seq, (1700000000 - max(event_id) OVER (PARTITION BY {_TYPES}) + event_id) * 1000000000 + 250000000 AS epoch_ns FROM events",
    "group_multiline": """WITH t AS (SELECT coalesce(conv_id, -1) AS c, coalesce(turn, -1) AS t, string_split(coalesce(text, ''), chr(10)) AS l, role FROM conversations),
 m AS (SELECT CAST((c + 1) // 100 AS INTEGER) AS path_id, c, t, len(l) + 1 AS n_lines,
 '2024-01-01 00:00:00 ' || coalesce(role, '') || chr(10) || array_to_string(list_transform(l, lambda x: '| ' || x || chr(10)), '') AS m FROM t)
 SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY c, t) AS seq, CAST(n_lines AS BIGINT) AS n_lines, CAST(strlen(m) AS BIGINT) AS n_bytes, md5(m) AS md5 FROM m""",
    "classify_path": """SELECT page_id, CASE page_id % 6 WHEN 3 THEN 'fixed:utmp' WHEN 4 THEN 'evtx' WHEN 5 THEN 'tar' ELSE 'text' END AS file_type,
 CASE page_id % 6 WHEN 2 THEN 'gz' WHEN 4 THEN 'xz' ELSE 'normal' END AS archive FROM pages""",
    "prepend_all": """SELECT path_id, seq, p || text || chr(10) || p || 'more' || chr(10) || '--' || chr(10) AS text FROM (SELECT *, 'src' || path_id || '|' ||
 strftime(make_timestamp(epoch_ns // 1000 + 19800000000), '%Y%m%dT%H%M%S') || '.000+0530|' AS p FROM """ + _SHIFTED + ")",
    "summary_total": f"""SELECT path_id, count(*) AS n_messages, count(*) AS n_lines, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, max(strlen(text)) AS longest, max(strlen(text)) AS longest_line,
 min(epoch_ns) AS first_ns, max(epoch_ns) AS last_ns FROM {_SHIFTED} GROUP BY ROLLUP (path_id)""",
    "processed_vs_accepted": f"""SELECT path_id, count(*) AS n_processed, min(epoch_ns) AS first_processed_ns, max(epoch_ns) AS last_processed_ns, count(*) FILTER (i) AS n_accepted,
 min(epoch_ns) FILTER (i) AS first_accepted_ns, max(epoch_ns) FILTER (i) AS last_accepted_ns, max(strlen(text)) AS largest_processed, coalesce(max(strlen(text)) FILTER (i), 0) AS largest_accepted
 FROM (SELECT *, epoch_ns BETWEEN {_AFTER} AND {_BEFORE} AS i FROM {_SHIFTED}) GROUP BY ROLLUP (path_id)""",
    "merge_position": f"SELECT path_id, seq, row_number() OVER (ORDER BY k, path_id, seq) AS position FROM (SELECT *, max(epoch_ns) {_RUN} AS k FROM {_SHIFTED})",
    "search_plain": _search_sql("strftime(t, '%Y-%m-%d %H:%M:%S')"),
    "search_gz": _search_sql("strftime(t, '%a %b %d %H:%M:%S %Y')"),
    "search_no_year": _search_sql("strftime(t, '%b %d %H:%M:%S')"),
    "search_takewhile": _search_sql("strftime(t, '%Y-%m-%dT%H:%M:%SZ')", f"epoch_ns >= {_AFTER}", f"k2 <= {_BEFORE}"),
    "journal_short": _journal_sql("strftime(t, '%b %d %H:%M:%S')", _SHORT_TEXT),
    "journal_short_precise": _journal_sql("strftime(t, '%Y-%m-%dT%H:%M:%S') || '.000000+0100'", _SHORT_TEXT),
    "journal_short_unix": _journal_sql("CAST(epoch_ns // 1000000000 AS VARCHAR) || '.000000'", _SHORT_TEXT),
    "journal_short_monotonic": _journal_sql("printf('%d.%06d', seq * 1500000 // 1000000, seq * 1500000 % 1000000)", _SHORT_TEXT.replace("stamp ||", "'[' || lpad(stamp, CAST(greatest(12, length(stamp)) AS INTEGER), ' ') || ']' ||")),
    "journal_export": _journal_sql("''", """'__CURSOR=' || cursor || chr(10) || '__REALTIME_TIMESTAMP=' || epoch_ns // 1000 || chr(10) || '__MONOTONIC_TIMESTAMP=' || seq * 1500000 || chr(10) || '_HOSTNAME=host' || chr(10)
 || CASE WHEN seq % 7 <> 0 THEN 'SYSLOG_IDENTIFIER=' || event_type || chr(10) ELSE '' END || '_COMM=comm' || chr(10) || CASE WHEN seq % 5 <> 0 THEN '_PID=' || user_id || chr(10) ELSE '' END
 || 'MESSAGE=event ' || seq || chr(10) || '_SOURCE_REALTIME_TIMESTAMP=1' || chr(10) || 'AAA=x' || chr(10) || chr(10)"""),
    "journal_verbose": _journal_sql("strftime(t, '%a %Y-%m-%d %H:%M:%S') || '.000000 +01:00'", """stamp || ' [' || cursor || ']' || chr(10) || '    _HOSTNAME=host' || chr(10)
 || CASE WHEN seq % 5 <> 0 THEN '    _PID=' || user_id || chr(10) ELSE '' END || '    _COMM=comm' || chr(10) || '    MESSAGE=event ' || seq || chr(10)
 || CASE WHEN seq % 7 <> 0 THEN '    SYSLOG_IDENTIFIER=' || event_type || chr(10) ELSE '' END || '    __MONOTONIC_TIMESTAMP=' || seq * 1500000 || chr(10) || '    AAA=x' || chr(10) || '    _SOURCE_REALTIME_TIMESTAMP=1' || chr(10)"""),
    "journal_cat": _journal_sql("''", "'event ' || seq || chr(10)"),
    "journal_window": f"SELECT path_id, seq, epoch_ns // 1000 AS realtime_us FROM (SELECT *, max(epoch_ns) {_RUN} AS k FROM {_SHIFTED}) WHERE epoch_ns >= {_AFTER} AND k < {_BEFORE}",
    "pattern_usage": f"SELECT {_TYPES} AS path_id, CASE event_id % 3 WHEN 0 THEN 'iso' ELSE 'ctime' END AS pattern, count(*) AS n FROM events WHERE event_id % 3 < 2 GROUP BY ALL",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
