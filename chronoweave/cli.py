"""Command line: options and their environment variables, output in merged order, errors and summary on standard error."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterable
from datetime import datetime

from chronoweave.functions import tz
from chronoweave.operators import journal, render
from chronoweave.plans import logs

#: Files with these statuses are passed over without a word.
SILENT = ("empty", "too_small", "unparsable", "unsupported")
PREFIX = "CHRONOWEAVE_"
DT_FORMAT = "%Y%m%dT%H%M%S%.3f%z"


def _local_offset() -> str:
    return tz.offset_text(int(datetime.now().astimezone().utcoffset().total_seconds()), True)


def parser(environment: dict[str, str]) -> argparse.ArgumentParser:
    """Every option has an environment variable: its long name in capitals behind ``PREFIX``."""
    p = argparse.ArgumentParser(prog="chronoweave", description="Search and merge log messages by datetime.")

    def option(*names, flag: bool = False, **more):
        given = environment.get(PREFIX + names[-1].lstrip("-").replace("-", "_").upper())
        if flag:
            p.add_argument(*names, action="store_true", default=given not in (None, "", "0", "false"), **more)
        else:
            p.add_argument(*names, default=given if given is not None else more.pop("default", None), **more)

    p.add_argument("paths", nargs="+", help="files or directories; - reads one path from each line of standard input")
    option("-a", "--after", help="messages at or after this datetime")
    option("-b", "--before", help="messages at or before this datetime")
    option("-t", "--tz-offset", default=_local_offset(), help="offset of datetimes without one")
    option("-z", "--prepend-tz", help="offset of the datetime in front of lines")
    option("-u", "--prepend-utc", flag=True)
    option("-l", "--prepend-local", flag=True)
    option("-d", "--prepend-dt-format", help=f"format of the datetime in front of lines, {DT_FORMAT} by default".replace("%", "%%"))
    option("-n", "--prepend-filename", flag=True)
    option("-p", "--prepend-filepath", flag=True)
    option("-w", "--prepend-file-align", flag=True)
    option("--prepend-separator", default=":")
    option("--separator", default="")
    option("--journal-output", default="short", choices=journal.OUTPUTS)
    option("-c", "--color", default="auto", choices=["always", "auto", "never", "a", "au", "n"])
    option("--light-theme", flag=True)
    option("-s", "--summary", flag=True)
    option("--compat", flag=True, help="all compatibility switches")
    return p


def options_of(args: argparse.Namespace, terminal: bool) -> logs.Options:
    """The search that the arguments ask for; contradictory or unknown ones raise ValueError."""
    zones = [bool(args.prepend_tz), args.prepend_utc, args.prepend_local]
    if sum(zones) > 1:
        raise ValueError("--prepend-tz, --prepend-utc and --prepend-local exclude each other")
    if args.prepend_filename and args.prepend_filepath:
        raise ValueError("--prepend-filename and --prepend-filepath exclude each other")
    zone = args.prepend_tz or ("+00:00" if args.prepend_utc else _local_offset() if args.prepend_local else None)
    form = args.prepend_dt_format or (DT_FORMAT if zone else None)
    for name in filter(None, (zone, args.tz_offset)):
        tz.option_seconds(name)
    coloured = args.color in ("always", "a") or (args.color in ("auto", "au") and terminal)
    found = logs.Options(
        after=args.after, before=args.before, tz_offset=args.tz_offset, file_prefix="name" if args.prepend_filename else "path" if args.prepend_filepath else None,
        file_align=args.prepend_file_align, dt_format=form, dt_zone=zone or (_local_offset() if form else None), prefix_separator=render.unescape(args.prepend_separator),
        separator=args.separator, journal_output=args.journal_output, theme=("light" if args.light_theme else "dark") if coloured else None,
    )
    render.unescape(args.separator)
    return logs.compat(found) if args.compat else found


def paths_of(given: Iterable[str], lines: Iterable[str], warn) -> list[str]:
    """Paths of the arguments; ``-`` stands for the lines of standard input, once."""
    out, read = [], False
    for path in given:
        if path != "-":
            out.append(path)
        elif read:
            warn("standard input was given more than once")
        else:
            out += [x.rstrip("\n") for x in lines if x.strip()]
            read = True
    return out


def summary_text(search: logs.Search) -> str:
    """The summary for people: each file, the files that were not read, the totals, and the resolved window."""
    rows = {r["path_id"]: r for r in search.summary().collect()}
    zone = tz.option_seconds(search.options.tz_offset)
    out = []
    for f in search.files:
        r = rows.get(f["path_id"])
        out.append(f"File: {f['shown']} ({f['file_type']}, {f['archive']}, {f['size']} bytes): {f['status']}{': ' + f['error'] if f['error'] else ''}")
        if r:
            out.append(f"  processed {r['n_processed']}, first {logs.instant(r['first_processed_ns'], zone)}, last {logs.instant(r['last_processed_ns'], zone)}")
            out.append(f"  printed {r['n_accepted']}, first {logs.instant(r['first_accepted_ns'], zone)}, last {logs.instant(r['last_accepted_ns'], zone)}, lines {r['n_lines']}, bytes {r['n_bytes']}")
    total, read = rows.get(None), [f for f in search.files if f["status"] == "ok"]
    number = lambda name: (total[name] if total else None) or 0
    after, before = search.bounds
    out += [
        "Program summary:",
        f"Paths considered       : {len(search.files)}", f"Paths not processed    : {len(search.files) - len(read)}", f"Files processed        : {len(read)}",
        f"Files printed          : {sum(1 for i, r in rows.items() if i is not None and r['n_accepted'])}", f"Printed bytes          : {number('n_bytes')}",
        f"Printed lines          : {number('n_lines')}", *[f"Printed {label:<15}: {number(f'n_{k}')}" for k, label in (("text", "text messages"), ("asl", "ASL events"), ("evtx", "EVTX events"), ("fixed", "records"), ("journal", "journal events"))],
        f"Line longest           : {number('longest_line')}", f"Message longest        : {number('longest')}", f"Largest processed      : {number('largest_processed')}", f"Largest accepted       : {number('largest_accepted')}",
        f"Datetime after         : {logs.instant(after, zone)}", f"Datetime before        : {logs.instant(before, zone)}",
    ]
    return "\n".join(out) + "\n"


def main(argv: list[str] | None = None, spark=None, stdin=None, stdout=None, stderr=None) -> int:
    """Runs a search; 0, or 1 where the arguments or a file were in error. A reader that goes away early is no error."""
    stdin, stdout, stderr = stdin or sys.stdin, stdout or sys.stdout, stderr or sys.stderr
    warn = lambda text: print(f"chronoweave: {text}", file=stderr)
    args = parser(dict(os.environ)).parse_intermixed_args(argv)
    try:
        options = options_of(args, getattr(stdout, "isatty", bool)())
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
        search = logs.plan(spark, paths_of(args.paths, stdin, warn), options)
    except ValueError as e:
        warn(str(e))
        return 1
    problems = [r for r in search.errors().collect() if r["status"] not in SILENT]
    for r in problems:
        warn(f"{r['shown']}: {r['status']}{': ' + r['error'] if r['error'] else ''}")
    try:
        for row in search.rendered().select("text").toLocalIterator():
            stdout.write(row["text"])
        stdout.flush()
    except BrokenPipeError:
        return 0
    if args.summary:
        stderr.write(summary_text(search))
    return 1 if problems else 0


if __name__ == "__main__":
    sys.exit(main())
