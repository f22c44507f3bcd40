"""Accounting records of fixed size (utmp, utmpx, lastlog, acct): layout by score, records as text."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Record bytes, kind, time (seconds offset and size, microseconds offset and size or None), strings, numbers.
# Strings are (name, offset, size), numbers (name, offset, struct code).
LAYOUTS = {
    "freebsd_x8664_utmpx": (280, "utmpx", (8, 8, 16, 8), [("ut_user", 36, 32), ("ut_line", 68, 16), ("ut_host", 84, 128)], [("ut_type", 0, "h"), ("ut_pid", 32, "i")]),
    "linux_arm64_lastlog": (296, "lastlog", (0, 8, None, 0), [("ll_line", 8, 32), ("ll_host", 40, 256)], []),
    "linux_arm64_utmpx": (400, "utmpx", (344, 8, 352, 8), [("ut_line", 8, 32), ("ut_id", 40, 4), ("ut_user", 44, 32), ("ut_host", 76, 256)], [("ut_type", 0, "h"), ("ut_pid", 4, "i"), ("ut_session", 336, "q")]),
    "linux_x86_acct": (64, "acct", (8, 4, None, 0), [("ac_comm", 36, 17)], [("ac_flag", 0, "B"), ("ac_uid", 2, "H"), ("ac_gid", 4, "H"), ("ac_tty", 6, "H"), ("ac_exitcode", 32, "I")]),
    "linux_x86_acct_v3": (64, "acct_v3", (24, 4, None, 0), [("ac_comm", 48, 16)], [("ac_flag", 0, "B"), ("ac_version", 1, "B"), ("ac_tty", 2, "H"), ("ac_exitcode", 4, "I"), ("ac_uid", 8, "I"), ("ac_gid", 12, "I"), ("ac_pid", 16, "I"), ("ac_ppid", 20, "I"), ("ac_etime", 28, "f")]),
    "linux_x86_lastlog": (292, "lastlog", (0, 4, None, 0), [("ll_line", 4, 32), ("ll_host", 36, 256)], []),
    "linux_x86_utmpx": (384, "utmpx", (340, 4, 344, 4), [("ut_line", 8, 32), ("ut_id", 40, 4), ("ut_user", 44, 32), ("ut_host", 76, 256)], [("ut_type", 0, "h"), ("ut_pid", 4, "i"), ("ut_session", 336, "i")]),
    "netbsd_x8632_acct": (56, "acct", (24, 8, None, 0), [("ac_comm", 0, 16)], [("ac_uid", 32, "I"), ("ac_gid", 36, "I"), ("ac_flag", 52, "B")]),
    "netbsd_x8632_lastlogx": (428, "lastlogx", (0, 8, 8, 4), [("ll_line", 12, 32), ("ll_host", 44, 256)], []),
    "netbsd_x8632_utmpx": (516, "utmpx", (464, 8, 472, 4), [("ut_user", 0, 32), ("ut_id", 32, 4), ("ut_line", 36, 32), ("ut_host", 68, 256)], [("ut_session", 324, "H"), ("ut_type", 326, "H"), ("ut_pid", 328, "i")]),
    "netbsd_x8664_lastlog": (32, "lastlog", (0, 8, None, 0), [("ll_line", 8, 8), ("ll_host", 16, 16)], []),
    "netbsd_x8664_lastlogx": (432, "lastlogx", (0, 8, 8, 4), [("ll_line", 16, 32), ("ll_host", 48, 256)], []),
    "netbsd_x8664_utmp": (40, "utmp", (32, 8, None, 0), [("ut_line", 0, 8), ("ut_name", 8, 8), ("ut_host", 16, 16)], []),
    "netbsd_x8664_utmpx": (520, "utmpx", (464, 8, 472, 4), [("ut_user", 0, 32), ("ut_id", 32, 4), ("ut_line", 36, 32), ("ut_host", 68, 256)], [("ut_session", 324, "H"), ("ut_type", 326, "H"), ("ut_pid", 328, "i")]),
    "openbsd_x86_lastlog": (272, "lastlog", (0, 8, None, 0), [("ll_line", 8, 8), ("ll_host", 16, 256)], []),
    "openbsd_x86_utmp": (304, "utmp", (296, 8, None, 0), [("ut_line", 0, 8), ("ut_name", 8, 32), ("ut_host", 40, 256)], []),
}
# Names of ut_type 0 to 11.
UT_TYPES = "EMPTY RUN_LVL BOOT_TIME NEW_TIME OLD_TIME INIT_PROCESS LOGIN_PROCESS USER_PROCESS DEAD_PROCESS ACCOUNTING SIGNATURE DOWN_TIME".split()
_SPAN = (1_000_000, 4_102_444_800)
RECORDS = "path_id int, seq long, epoch_ns long, dt_beg int, dt_end int, layout string, raw binary"


def _number(data: bytes, offset: int, size: int) -> int:
    return int.from_bytes(data[offset : offset + size], "little", signed=True)


def _text(data: bytes, offset: int, size: int) -> bytes:
    return data[offset : offset + size].split(b"\0")[0]


# Points of a record by how it looks.
PRINTABLE, FF_BYTE, OTHER_BYTE, NOT_EMPTY, ENDED, AFTER_END, PLAUSIBLE, IMPLAUSIBLE, ZERO_TIME, GOOD_TYPE, BAD_TYPE, HINT = 2, -5, -3, 1, 10, -5, 20, -30, -40, 5, -30, 15


def _score(data: bytes, layout: tuple) -> int:
    """How far a record looks like the layout: printable NUL-ended strings and a plausible time."""
    total = 0
    for _, offset, size in layout[3]:
        part, text = data[offset : offset + size], _text(data, offset, size)
        total += sum(PRINTABLE if 32 <= b < 127 else FF_BYTE if b == 255 else OTHER_BYTE for b in text) + (NOT_EMPTY if text else 0)
        total += ENDED if b"\0" in part else -ENDED
        total += AFTER_END if any(part[len(text) :]) else 0
    when = _number(data, layout[2][0], layout[2][1])
    total += ZERO_TIME if when == 0 else PLAUSIBLE if _SPAN[0] <= when <= _SPAN[1] else IMPLAUSIBLE
    for name, offset, code in layout[4]:
        if name == "ut_type":
            total += GOOD_TYPE if 0 <= struct.unpack_from("<" + code, data, offset)[0] < len(UT_TYPES) else BAD_TYPE
    return total


def layout_of(content: bytes, hint: str) -> str | None:
    """The layout whose record size divides the file and whose first five records score best; ties go to the earlier one."""
    best, chosen = None, None
    for name, layout in LAYOUTS.items():
        size = layout[0]
        if not content or len(content) % size:
            continue
        records = [content[i : i + size] for i in range(0, len(content), size)]
        records = [r for r in records if any(r) and r != b"\xff" * size][:5]
        if not records:
            continue
        score = max(_score(r, layout) for r in records) + (HINT if layout[1] == hint or layout[1].rstrip("x") == hint else 0)
        if best is None or score > best:
            best, chosen = score, name
    return chosen


def decode(data: bytes, name: str) -> tuple[int, int, str, int, int]:
    """Seconds, microseconds, the record as ``name value`` pairs, and where the time stands in them."""
    _, _, (at, size, at_us, size_us), strings, numbers = LAYOUTS[name]
    seconds = _number(data, at, size)
    micros = _number(data, at_us, size_us) if at_us is not None else 0
    micros = micros if 0 <= micros < 1_000_000 else 0
    parts = []
    for field, offset, code in numbers:
        value = struct.unpack_from("<" + code, data, offset)[0]
        if field == "ut_type" and 0 <= value < len(UT_TYPES):
            value = UT_TYPES[value]
        elif field == "ac_flag":
            value = f"0b{value:04b}"
        parts.append(f"{field} {value}")
    parts += [f"{field} '{_text(data, offset, length).decode('utf-8', 'replace')}'" for field, offset, length in strings]
    label = {"u": "ut_tv", "l": "ll_time", "a": "ac_btime"}[LAYOUTS[name][1][0]]
    front = " ".join([*parts, label]) + " "
    stamp = f"{seconds}.{micros}" if at_us is not None else str(seconds)
    return seconds, micros, f"{front}{stamp}\n", len(front.encode()), len((front + stamp).encode())


def records(data: bytes, hint: str, dedup_times: bool = False) -> list[tuple[int, int, int, str, bytes]]:
    """(instant in ns, begin and end of the time in the text, layout, text) of a file's records in (time, offset) order.

    Null records and zero times are left out; ``dedup_times`` keeps only the last record of each time.
    """
    name, found = layout_of(data, hint), []
    if name is None:
        return []
    size = LAYOUTS[name][0]
    for place in range(0, len(data), size):
        record = data[place : place + size]
        if not any(record) or record == b"\xff" * size:
            continue
        seconds, micros, text, begin, end = decode(record, name)
        if (seconds, micros) != (0, 0):
            found.append(((seconds, micros), place, text, begin, end))
    found.sort(key=lambda r: r[:2])
    if dedup_times:
        found = list({r[0]: r for r in found}.values())
    return [((s * 1_000_000 + u) * 1000, b, e, name, t.encode()) for (s, u), _, t, b, e in found]


def read_records(spark: SparkSession, files: list[dict], dedup_times: bool = False) -> DataFrame:
    """``RECORDS`` of all files; seq from 1. A file that can't be unpacked or has no known layout gives none."""
    from chronoweave.sources.text import by_path, contents, whole_files

    how = by_path(files)

    def read(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                for f, data, _ in contents(how, path, bytes(content)):
                    found = records(data, f["file_type"].split(":")[1], dedup_times) if data is not None else []
                    rows = [(f["path_id"], i, at, b, e, name, t) for i, (at, b, e, name, t) in enumerate(found, 1)]
                    yield pd.DataFrame(rows, columns=["path_id", "seq", "epoch_ns", "dt_beg", "dt_end", "layout", "raw"])

    return whole_files(spark, files).mapInPandas(read, RECORDS)
