"""Apple System Log databases: records of the ``ASL DB`` format (public header layout), each as one line."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

# Signature and names of levels.
SIGNATURE = b"ASL DB\0\0\0\0\0\0"
LEVELS = "Emergency Alert Critical Error Warning Notice Info Debug".split()
_RECORD = struct.Struct(">2xI3QI2H7I6Q")


def _text(data: bytes, value: int) -> str:
    """A string: none, up to seven bytes inside the number itself, or a place in the file."""
    if value == 0:
        return ""
    if value >> 63:
        raw = struct.pack(">Q", value)
        return raw[1 : 1 + (raw[0] & 0x7F)].decode("utf-8", "replace")
    if data[value : value + 2] != b"\0\1":
        raise ValueError(f"no string at {value}")
    size = struct.unpack_from(">I", data, value + 2)[0]
    return data[value + 6 : value + 5 + size].decode("utf-8", "replace")


def records(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(instant in ns, begin and end of the datetime, line) of each record, in the order of the file's chain."""
    if data[:12] != SIGNATURE:
        raise ValueError("not an ASL database")
    at, last = struct.unpack_from(">Q", data, 16)[0], struct.unpack_from(">Q", data, 37)[0]
    seen = set()
    while at and at not in seen:
        seen.add(at)
        _, following, number, seconds, nanos, level, _flags, pid, _uid, gid, ruid, rgid, _refpid, pairs, *refs = _RECORD.unpack_from(data, at)
        host, sender, facility, message, refproc, session = (_text(data, r) for r in refs)
        keys = struct.unpack_from(f">{pairs // 2 * 2}Q", data, at + _RECORD.size)
        stamp = (datetime(1970, 1, 1) + timedelta(seconds=seconds, microseconds=nanos // 1000)).isoformat()
        parts = [stamp, f"id={number}", f"level={LEVELS[level] if level < len(LEVELS) else 'Other'}", f"pid={pid}", f"gid={gid}", f"read_uid={ruid}", f"read_gid={rgid}"]
        parts += [f"{name}={value}" for name, value in (("host", host), ("RefProc", refproc), ("session", session)) if value]
        parts += [f"sender={sender}", f"facility={facility}", f"message='{message}'"]
        parts += [f"{_text(data, k)}={_text(data, v)}" for k, v in zip(keys[::2], keys[1::2])]
        line = "  ".join(parts).replace("\0", " ") + "\n"
        # an event's time counts in milliseconds
        yield (seconds * 1000 + nanos // 1_000_000) * 1_000_000, 0, len(stamp), line.encode()
        if at == last:
            return
        at = following
