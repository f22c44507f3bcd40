"""Journal entries as text, in the output forms of journal viewers; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.render import format_datetime

# Datetime formats of the short forms, and the order of fields in the verbose form.
SHORT = {
    "short": "%b %d %H:%M:%S",
    "short-precise": "%b %d %H:%M:%S.%6f",
    "short-iso": "%Y-%m-%d %H:%M:%S",
    "short-iso-precise": "%Y-%m-%dT%H:%M:%S.%6f%z",
    "short-full": "%a %Y-%m-%d %H:%M:%S %:z",
    "short-unix": "%s.%6f",
}
VERBOSE = "%a %Y-%m-%d %H:%M:%S.%6f %:z"
VERBOSE_ORDER = (
    "_TRANSPORT _UID _GID _FSUID _CAP_EFFECTIVE _SELINUX_CONTEXT _AUDIT_FIELD_APPARMOR _AUDIT_FIELD_ARCH _AUDIT_FIELD_CAPABILITY "
    "_AUDIT_FIELD_CAPNAME _AUDIT_FIELD_CLASS _AUDIT_FIELD_CODE _AUDIT_FIELD_COMPAT _AUDIT_FIELD_DENIED_MASK _AUDIT_FIELD_INFO "
    "_AUDIT_FIELD_IP _AUDIT_FIELD_NAME _AUDIT_FIELD_OPERATION _AUDIT_FIELD_OUID _AUDIT_FIELD_PROFILE _AUDIT_FIELD_REQUESTED_MASK "
    "_AUDIT_FIELD_SIG _AUDIT_FIELD_SYSCALL _AUDIT_ID _AUDIT_LOGINUID _AUDIT_SESSION _AUDIT_TYPE _AUDIT_TYPE_NAME _BOOT_ID _MACHINE_ID "
    "_HOSTNAME PRIORITY _PID TID _COMM _EXE _CMDLINE _SYSTEMD_CGROUP _SYSTEMD_OWNER_UID _SYSTEMD_UNIT _SYSTEMD_USER_UNIT _SYSTEMD_SLICE "
    "_SYSTEMD_USER_SLICE _SYSTEMD_INVOCATION_ID _STREAM_ID _KERNEL_SUBSYSTEM _KERNEL_DEVICE _UDEV_SYSNAME GLIB_DOMAIN GLIB_OLD_LOG_API "
    "GNOME_SHELL_EXTENSION_NAME GNOME_SHELL_EXTENSION_UUID THREAD_ID CODE_FILE CODE_LINE CODE_FUNC INVOCATION_ID SESSION_ID USER_ID "
    "LEADER UNIT UNIT_RESULT JOB_ID JOB_TYPE JOB_RESULT N_RESTARTS PULSE_BACKTRACE TIMESTAMP_MONOTONIC TIMESTAMP_BOOTTIME KERNEL_USEC "
    "USERSPACE_USEC CPU_USAGE_NSEC MESSAGE_ID SEAT_ID MESSAGE SHUTDOWN JOURNAL_NAME JOURNAL_PATH CURRENT_USE CURRENT_USE_PRETTY MAX_USE "
    "MAX_USE_PRETTY DISK_KEEP_FREE DISK_KEEP_FREE_PRETTY DISK_AVAILABLE DISK_AVAILABLE_PRETTY LIMIT LIMIT_PRETTY AVAILABLE "
    "AVAILABLE_PRETTY EXIT_CODE EXIT_STATUS COMMAND SYSLOG_FACILITY SYSLOG_IDENTIFIER SYSLOG_PID SYSLOG_RAW SYSLOG_TIMESTAMP NM_DEVICE "
    "NM_LOG_DOMAINS NM_LOG_LEVEL __MONOTONIC_TIMESTAMP"
).split()
OUTPUTS = [*SHORT, "short-monotonic", "verbose", "export", "cat"]


def _value(key: str) -> Column:
    """The value of a field, the first one where it occurs more often; null without it."""
    at = F.array_position("keys", key)
    return F.when(at > 0, F.get("values", (at - 1).cast("int")))


def _joined(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))


def _bytes(text: Column) -> Column:
    return text.cast("binary")


def in_journal_window(entries: DataFrame, after: int | None, before: int | None, before_exclusive: bool = False) -> DataFrame:
    """Entries from ``after`` to ``before`` (ns), both included; ``before_exclusive`` ends a file at its first entry at or past it."""
    if after is not None:
        entries = entries.where(F.col("realtime_us") * 1000 >= after)
    if before is None:
        return entries
    return entries.where(F.col("high_us") * 1000 < before) if before_exclusive else entries.where(F.col("realtime_us") * 1000 <= before)


def journal_text(entries: DataFrame, output: str, tz_offset_s: int) -> DataFrame:
    """Adds raw (the entry in the given form), and dt_beg and dt_end of the datetime in it.

    The datetime is the time at which the journal got the entry. Fields keep the file's order but in the verbose
    form; a missing field is left out with its punctuation.
    """
    if output not in OUTPUTS:
        raise ValueError(f"unknown journal output {output!r}")
    zone, at = F.lit(tz_offset_s), F.col("realtime_us") * 1000
    none = F.lit(b"")
    begin, size = F.lit(0), F.lit(0)
    if output == "cat":
        raw = F.concat(F.coalesce(_value("MESSAGE"), none), F.lit(b"\n"))
    elif output == "export":
        fields = F.zip_with("keys", "values", lambda k, v: F.concat(_bytes(k), F.lit(b"="), v, F.lit(b"\n")))
        numbers = F.concat(
            F.lit("__CURSOR="), "cursor", F.lit("\n__REALTIME_TIMESTAMP="), F.col("realtime_us").cast("string"), F.lit("\n__MONOTONIC_TIMESTAMP="), F.col("monotonic_us").cast("string"), F.lit("\n")
        )
        raw = F.concat(_bytes(numbers), _joined(fields), F.lit(b"\n"))
    elif output == "verbose":
        front = format_datetime(at, VERBOSE, zone)
        entries = entries.withColumn("_map", F.map_from_arrays(F.array_distinct("keys"), F.transform(F.array_distinct("keys"), lambda k: F.element_at(F.col("values"), F.array_position("keys", k).cast("int")))))
        entries = entries.withColumn("_map", F.map_concat(F.map_filter("_map", lambda k, v: k != "__MONOTONIC_TIMESTAMP"), F.create_map(F.lit("__MONOTONIC_TIMESTAMP"), F.coalesce(_value("__MONOTONIC_TIMESTAMP"), _bytes(F.col("monotonic_us").cast("string"))))))
        order = F.array(*[F.lit(k) for k in VERBOSE_ORDER])
        known = F.filter(order, lambda k: F.map_contains_key("_map", k))
        others = F.array_sort(F.filter(F.map_keys("_map"), lambda k: ~F.array_contains(order, k) & (k != "_SOURCE_REALTIME_TIMESTAMP")))
        last = F.filter(F.map_keys("_map"), lambda k: k == "_SOURCE_REALTIME_TIMESTAMP")
        trimmed = lambda k: F.when(k == "_SELINUX_CONTEXT", F.rtrim(F.element_at("_map", k).cast("string"), F.lit("\0\r\n ")).cast("binary")).otherwise(F.element_at("_map", k))
        fields = F.transform(F.concat(known, others, last), lambda k: F.concat(F.lit(b"    "), _bytes(k), F.lit(b"="), trimmed(k), F.lit(b"\n")))
        raw = F.concat(_bytes(F.concat(front, F.lit(" ["), "cursor", F.lit("]\n"))), _joined(fields))
        size = F.octet_length(front)
    else:
        if output == "short-monotonic":
            number = F.concat(F.expr("monotonic_us div 1000000").cast("string"), F.lit("."), F.lpad((F.col("monotonic_us") % 1_000_000).cast("string"), 6, "0"))
            # lpad would cut longer numbers
            number = F.concat(F.repeat(F.lit(" "), 12 - F.char_length(number)), number)
            front = F.concat(F.lit("["), number, F.lit("]"))
            begin, size = F.lit(1) + F.octet_length(number) - F.octet_length(F.ltrim(number)), F.octet_length(F.ltrim(number))
        else:
            front = format_datetime(at, SHORT[output], zone)
            size = F.octet_length(front)
        after = lambda mark, value, end=b"": F.when(value.isNotNull(), F.concat(F.lit(mark), value, F.lit(end))).otherwise(none)
        name, pid = F.coalesce(_value("SYSLOG_IDENTIFIER"), _value("_COMM")), F.coalesce(_value("_PID"), _value("SYSLOG_PID"))
        raw = F.concat(_bytes(front), after(b" ", _value("_HOSTNAME")), after(b" ", name), after(b"[", pid, b"]"), after(b": ", _value("MESSAGE")), F.lit(b"\n"))
    return entries.withColumn("raw", raw).withColumn("dt_beg", begin.cast("int")).withColumn("dt_end", (begin + size).cast("int")).drop("_map")
