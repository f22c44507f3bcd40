"""Messages as text: file and datetime in front of every line, separators, summaries."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import tz

_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "n": "\n", "r": "\r", "\\": "\\", "t": "\t", "v": "\v"}
_SPARK = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "I": "hh", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}


def unescape(text: str) -> str:
    """Backslash escapes of a separator option; an unknown one raises ValueError."""

    def one(found: re.Match) -> str:
        if found[1]:
            return chr(int(found[1], 16))
        if found[2] not in _ESCAPES:
            raise ValueError(f"unknown escape {found[0]!r}")
        return _ESCAPES[found[2]]

    return re.sub(r"\\(?:[xX]([0-9a-fA-F]{2})|(.?))", one, text, flags=re.S)


def format_datetime(epoch_ns: Column, form: str, zone_s: Column) -> Column:
    """strftime-like text of an instant at an offset, with %f, %3f, %.9f, %z, %:z, %s and nanoseconds."""
    nanos = F.pmod(epoch_ns, F.lit(1_000_000_000))
    seconds = ((epoch_ns - nanos) / 1_000_000_000).cast("bigint")
    wall = tz.utc_wall(seconds + zone_s)
    digits = F.lpad(nanos.cast("string"), 9, "0")
    sign, size = F.when(zone_s < 0, "-").otherwise("+"), F.abs(zone_s)
    hours = F.lpad(F.floor(size / 3600).cast("string"), 2, "0")
    minutes = F.lpad(F.floor(size % 3600 / 60).cast("string"), 2, "0")
    parts = []
    for literal, dot, width, code in _tokens(form):
        if literal:
            parts.append(F.lit(literal))
        elif code == "f":
            parts.append(F.concat(F.lit(dot), F.substring(digits, 1, int(width or 9))))
        elif code in ("z", ":z"):
            parts.append(F.concat(sign, hours, F.lit(":" if code == ":z" else ""), minutes))
        elif code == "s":
            parts.append(seconds.cast("string"))
        elif code == "e":
            parts.append(F.lpad(F.dayofmonth(wall).cast("string"), 2, " "))
        elif code == "%":
            parts.append(F.lit("%"))
        elif code in _SPARK:
            parts.append(F.date_format(wall, _SPARK[code]))
        else:
            raise ValueError(f"unknown datetime code %{code}")
    return F.concat(*parts) if parts else F.lit("")


def _tokens(form: str):
    """(literal, dot, width, code) of each part of a format."""
    for found in re.finditer(r"([^%]+)|%(\.?)([369]?)(f)|%(:?.)", form):
        yield found[1], found[2] or "", found[3], found[4] or found[5]


# Terminal colours (of 256) that files take in turn, for dark and for light backgrounds, and the codes around them.
DARK = [118, 45, 213, 220, 51, 208, 141, 156, 81, 203, 227, 111, 215, 120, 177, 87, 229, 75, 210, 154, 123, 219, 190, 69, 222, 159, 183, 46]
LIGHT = [22, 18, 89, 94, 23, 130, 55, 28, 24, 88, 58, 19, 136, 29, 90, 30, 100, 20, 124, 64, 31, 127, 70, 17, 95, 37, 53, 2]
_COLOUR, _RESET, _LINE, _NO_LINE = "\x1b[38;5;", "\x1b[0m", "\x1b[4m", "\x1b[24m"


def rendered(
    messages: DataFrame, name: Column | None = None, dt_format: str | None = None, zone: str | None = None, prefix_separator: str = ":", separator: str = "",
    theme: str | None = None, drop_tail: bool = False,
) -> DataFrame:
    """Adds ``text``: each line of a message with file and datetime in front, then the separator.

    ``zone`` None shows each message in its own offset; ``name`` is the file part. A text message without a newline at its end (the
    last of its file) gets one, behind the separator. Bytes behind the last newline of a record or event are
    printed as they are, or with ``drop_tail`` left out where something stands in front of lines. ``theme`` (dark or
    light) colours each message by its file and underlines its datetime.
    """
    zone_s = F.col("tz_offset_s") if zone is None else F.lit(tz.option_seconds(zone))
    front = [name, F.lit(prefix_separator)] if name is not None else []
    if dt_format is not None:
        front += [format_datetime(F.col("epoch_ns"), dt_format, zone_s), F.lit(prefix_separator)]
    is_text = F.col("kind") == "text" if "kind" in messages.columns else F.lit(True)
    raw = F.col("raw")
    if theme is not None:
        colours = F.array(*[F.lit(f"{_COLOUR}{c}m") for c in (LIGHT if theme == "light" else DARK)])
        on, beg, end = F.get(colours, F.col("path_id") % len(DARK)), F.coalesce("dt_beg", F.lit(0)), F.coalesce("dt_end", F.lit(0))
        bare = F.when(raw.endswith(F.lit(b"\n")), F.substring(raw, F.lit(1), F.octet_length(raw) - 1)).otherwise(raw)
        marked = F.concat(F.substring(bare, F.lit(1), beg), F.lit(_LINE.encode()), F.substring(bare, beg + 1, end - beg), F.lit(_NO_LINE.encode()), F.substring(bare, end + 1, F.octet_length(bare)))
        raw = F.concat(on.cast("binary"), F.when(end > beg, marked).otherwise(bare), F.lit(_RESET.encode()), F.when(raw.endswith(F.lit(b"\n")), F.lit(b"\n")).otherwise(F.lit(b"")))
    body = raw.cast("string")
    ended = body.endswith("\n")
    if front:
        lines = F.split(F.when(ended, F.substr(body, F.lit(1), F.char_length(body) - 1)).otherwise(body), "\n")
        many = F.array_join(F.transform(lines, lambda x: F.concat(*front, x)), "\n")
        many = F.when(ended, F.concat(many, F.lit("\n"))).otherwise(many)
        if drop_tail:
            head = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))
            whole = F.concat(F.array_join(F.transform(head, lambda x: F.concat(*front, x, F.lit("\n"))), ""))
            many = F.when(is_text | ended, many).otherwise(whole)
        body = many
    last = F.when(is_text & ~ended, "\n").otherwise("")
    return messages.withColumn("text", F.concat(body, F.lit(unescape(separator)), last))


def display_width(text: str) -> int:
    """Columns that a terminal takes for the text: wide characters two, combining ones none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def summary(messages: DataFrame) -> DataFrame:
    """Per source and, with a null path_id, in total: messages, lines, bytes, longest message and line, first and last instant."""
    rows = messages.withColumn("_line", F.array_max(F.transform(F.split(F.col("raw").cast("string"), "(?<=\n)"), lambda x: F.octet_length(x))))
    return rows.rollup("path_id").agg(
        F.count("*").alias("n_messages"), F.sum("n_lines").alias("n_lines"), F.sum(F.octet_length("raw")).alias("n_bytes"),
        F.max(F.octet_length("raw")).cast("bigint").alias("longest"), F.max("_line").cast("bigint").alias("longest_line"),
        F.min("epoch_ns").alias("first_ns"), F.max("epoch_ns").alias("last_ns"),
    )


def accepted(messages: DataFrame, inside: Column) -> DataFrame:
    """Per source and, with a null path_id, in total: messages read and those inside the window, with their first and last instants."""
    only = lambda c: F.when(inside, c)
    return messages.rollup("path_id").agg(
        F.count("*").alias("n_processed"), F.min("epoch_ns").alias("first_processed_ns"), F.max("epoch_ns").alias("last_processed_ns"),
        F.count(only(F.lit(1))).alias("n_accepted"), F.min(only(F.col("epoch_ns"))).alias("first_accepted_ns"), F.max(only(F.col("epoch_ns"))).alias("last_accepted_ns"),
        F.coalesce(F.max(F.octet_length("raw")), F.lit(0)).cast("bigint").alias("largest_processed"), F.coalesce(F.max(only(F.octet_length("raw"))), F.lit(0)).cast("bigint").alias("largest_accepted"),
    )


def pattern_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("path_id", "pattern_id").agg(F.count("*").alias("n"))
