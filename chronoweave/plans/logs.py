"""Whole queries over log files: paths in, merged and rendered messages, summaries and errors out."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import patterns, tz, window
from chronoweave.operators import journal as journal_operators
from chronoweave.operators import merge, messages, render
from chronoweave.plans.shared import written
from chronoweave.sources import errors, events, fixed, journal, text
from chronoweave.sources import files as file_source


@dataclass(frozen=True)
class Options:
    """What a search asks for; see the modules that use each value. The compatibility switches are off by default."""

    after: str | None = None
    before: str | None = None
    tz_offset: str = "+00:00"
    file_prefix: str | None = None  # "name" or "path"
    file_align: bool = False
    dt_format: str | None = None
    dt_zone: str | None = None
    prefix_separator: str = ":"
    separator: str = ""
    journal_output: str = "short"
    theme: str | None = None  # "dark" or "light": colours
    merge: str = "kway"  # "time" orders by datetime alone
    ordering: str = "strict"
    profile: str = "clean"
    compat_epoch: bool = False
    journal_before_exclusive: bool = False
    fixed_dedup_times: bool = False
    drop_unterminated_binary_tail: bool = False
    single_member_gzip_xz: bool = False


COMPAT = Options(
    ordering="compat", profile="compat", compat_epoch=True, journal_before_exclusive=True, fixed_dedup_times=True, drop_unterminated_binary_tail=True, single_member_gzip_xz=True
)
#: Files up to this size are never split, so they are one block.
NEVER_SPLIT = "spark.sql.files.openCostInBytes"
_OUT = ["path_id", "seq", "kind", "epoch_ns", "tz_offset_s", "pattern_id", "dt_beg", "dt_end", "n_lines", "merge_key", "inside", "raw"]


def _never_split(spark: SparkSession) -> int:
    value = spark.conf.get(NEVER_SPLIT)
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    value = value.lower().removesuffix("b") or "0"
    bytes_ = int(value[:-1]) * units[value[-1]] if value[-1] in units else int(value)
    most = spark.conf.get("spark.sql.files.maxPartitionBytes").lower().removesuffix("b")
    most = int(most[:-1]) * units[most[-1]] if most[-1] in units else int(most)
    return min(bytes_, most)


def _texts(spark: SparkSession, files: list[dict], options: Options, how: messages.Grouping) -> DataFrame:
    """Messages of text files; files that may have several blocks get two more passes over them."""
    zone = tz.option_seconds(options.tz_offset)
    parts = []
    bound = _never_split(spark)
    for several in (False, True):
        own = [f for f in files if (f["size"] > bound or f["archive"] != "normal") == several]
        if not own:
            continue
        known = file_source.files_frame(spark, own).select("path", "path_id", "mtime", "patterns", "newline")
        lines = text.read_lines(spark, own, known, options.single_member_gzip_xz)
        stamped = messages.with_datetimes(lines, zone, options.compat_epoch, "patterns").drop("patterns")
        if not several:
            parts.append(messages.grouped(stamped, how))
            continue
        if any(not patterns.BY_ID[i].has_year for f in own for i in f["patterns"]):
            stamped = messages.attached(stamped, messages.turns_after(messages.block_stats(stamped, how)))
        parts.append(messages.grouped(messages.attached(stamped, messages.bases(messages.block_stats(stamped, how))), how))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_messages(spark: SparkSession, files: list[dict], options: Options = Options(), after: int | None = None, before: int | None = None, flag: bool = False) -> DataFrame:
    """Messages of all readable files inside the window (ns): ``_OUT``. With ``flag`` those outside, too, told apart by inside.

    Files with another status than ``ok`` are left out; it is the caller's to report them.
    """
    zone = tz.option_seconds(options.tz_offset)
    good = [f for f in files if f["status"] == "ok"]
    parts = []
    own = [f for f in good if f["file_type"] == "text"]
    if own:
        how = messages.Grouping(zone, options.compat_epoch, after, before, options.ordering, flag)
        parts.append(_texts(spark, own, options, how).withColumn("kind", F.lit("text")))
    own = [f for f in good if f["file_type"].startswith("fixed:")]
    if own:
        found = fixed.read_records(spark, own, options.fixed_dedup_times)
        parts.append(_placed(found.withColumn("merge_key", F.col("epoch_ns")), "fixed", zone, after, before, flag))
    for kind in ("evtx", "asl"):
        own = [f for f in good if f["file_type"] == kind]
        if own:
            parts.append(_placed(events.read_events(spark, own), kind, zone, after, before, flag))
    own = [f for f in good if f["file_type"] == "journal"]
    if own:
        found = journal.read_entries(spark, own)
        keep = found if flag else journal_operators.in_journal_window(found, after, before, options.journal_before_exclusive)
        made = journal_operators.journal_text(keep, options.journal_output, zone)
        made = made.withColumn("epoch_ns", F.col("realtime_us") * 1000).withColumn("merge_key", F.col("high_us") * 1000)
        parts.append(_placed(made, "journal", zone, after if flag else None, before if flag else None, flag))
    if not parts:
        return spark.createDataFrame([], "path_id int, seq long, kind string, epoch_ns long, tz_offset_s int, pattern_id int, dt_beg int, dt_end int, n_lines long, merge_key long, inside boolean, raw binary")
    out = parts[0].select(_OUT)
    for part in parts[1:]:
        out = out.unionByName(part.select(_OUT))
    return out


def _placed(found: DataFrame, kind: str, zone: int, after: int | None, before: int | None, flag: bool) -> DataFrame:
    """Records or events as messages: those inside the window, wherever they stand in their file."""
    inside = (F.col("epoch_ns") >= after if after is not None else F.lit(True)) & (F.col("epoch_ns") <= before if before is not None else F.lit(True))
    n_lines = F.octet_length("raw") - F.octet_length(F.translate(F.col("raw").cast("string"), "\n", ""))
    out = found.select(
        "path_id", "seq", F.lit(kind).alias("kind"), "epoch_ns", F.lit(zone).alias("tz_offset_s"), F.lit(None).cast("int").alias("pattern_id"), "dt_beg", "dt_end",
        n_lines.cast("bigint").alias("n_lines"), "merge_key", inside.alias("inside"), "raw",
    )
    return out if flag else out.where("inside")


@dataclass(frozen=True)
class Search:
    """One search: its files, its window and its messages, not yet rendered."""

    spark: SparkSession
    options: Options
    files: list[dict]
    after: datetime | None
    before: datetime | None

    @property
    def bounds(self) -> tuple[int | None, int | None]:
        return self.after and window.nanoseconds(self.after), self.before and window.nanoseconds(self.before)

    def messages(self, flag: bool = False) -> DataFrame:
        return read_messages(self.spark, self.files, self.options, *self.bounds, flag=flag)

    def rendered(self) -> DataFrame:
        """Messages with ``text``, in merged order."""
        o, inside = self.options, self.messages()
        name = None
        if o.file_prefix:
            names = {f["path_id"]: f["shown"] if o.file_prefix == "path" else f["shown"].rsplit("/", 1)[-1].rsplit("|", 1)[-1] for f in self.files}
            if o.file_align:
                inside = written(inside)
                wide = max((render.display_width(names[r["path_id"]]) for r in inside.select("path_id").distinct().collect()), default=0)
                names = {i: n + " " * (wide - render.display_width(n)) for i, n in names.items()}
            listed = self.spark.createDataFrame(list(names.items()), "_id int, _name string")
            inside = inside.join(F.broadcast(listed), F.col("path_id") == F.col("_id")).drop("_id")
            name = F.col("_name")
        out = render.rendered(inside, name, o.dt_format, o.dt_zone, o.prefix_separator, o.separator, o.theme, o.drop_unterminated_binary_tail).drop("_name")
        return out.orderBy("merge_key" if o.merge == "kway" else "epoch_ns", "path_id", "seq")

    def errors(self) -> DataFrame:
        """path_id, shown, status, error of the files that were not or not wholly read; empty and too small ones included."""
        bad = errors.read_errors(self.spark, self.files)
        rows = [(f["path_id"], f["shown"], "corrupt" if f["path_id"] in bad else f["status"], bad.get(f["path_id"], f["error"])) for f in self.files if f["status"] != "ok" or f["path_id"] in bad]
        return self.spark.createDataFrame(rows, "path_id int, shown string, status string, error string")

    def summary(self) -> DataFrame:
        """Per file, and in total with a null path_id: what was read, what lay inside the window, what was printed."""
        every = self.messages(flag=True)
        counts = render.accepted(every, F.col("inside"))
        printed = render.summary(every.where("inside")).withColumnRenamed("path_id", "_id")
        kinds = every.where("inside").rollup("path_id").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in ("text", "fixed", "evtx", "journal", "asl")]).withColumnRenamed("path_id", "_kid")
        out = counts.join(printed, F.col("path_id").eqNullSafe(F.col("_id")), "left").join(kinds, F.col("path_id").eqNullSafe(F.col("_kid")), "left")
        return out.drop("_id", "_kid").na.fill(0, ["n_messages", "n_lines", "n_bytes", "longest", "longest_line", *[f"n_{k}" for k in ("text", "fixed", "evtx", "journal", "asl")]])


def plan(spark: SparkSession, paths: list[str], options: Options = Options(), mtimes: dict[str, float] | None = None, now: datetime | None = None) -> Search:
    """Lists the files and resolves the window; nothing is read yet but the files' first bytes."""
    after, before = window.resolve_window(options.after, options.before, options.tz_offset, now)
    return Search(spark, options, file_source.list_files(spark, paths, mtimes, options.profile), after, before)


def search(spark: SparkSession, paths: list[str], options: Options = Options(), mtimes: dict[str, float] | None = None) -> DataFrame:
    """Rendered messages of all files inside the window, in merged order."""
    return plan(spark, paths, options, mtimes).rendered()


def compat(options: Options) -> Options:
    """The same search with all compatibility switches on."""
    on = {k: getattr(COMPAT, k) for k in ("ordering", "profile", "compat_epoch", "journal_before_exclusive", "fixed_dedup_times", "drop_unterminated_binary_tail", "single_member_gzip_xz")}
    return replace(options, **on)


def instant(ns: int | None, zone: int = 0) -> str:
    """An instant for people, in the given offset."""
    if ns is None:
        return ""
    at = datetime.fromtimestamp(ns // 10**9 + zone, timezone.utc)
    return f"{at:%Y-%m-%d %H:%M:%S}.{ns % 10**9 // 10**6:03} {tz.offset_text(zone, True)}"
