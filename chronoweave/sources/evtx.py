"""Windows event logs: records of the public EVTX format, their binary XML written out as text."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.sax.saxutils import escape

# Signatures, sizes and the distance from 1601 to 1970 in units of 100 ns.
FILE, CHUNK, RECORD = b"ElfFile\0", b"ElfChnk\0", b"\x2a\x2a\0\0"
FILE_HEADER, CHUNK_SIZE, CHUNK_HEADER = 4096, 65536, 512
EPOCH = 116_444_736_000_000_000
_BEFORE, _AFTER = b'<TimeCreated SystemTime="', b'"'
_QUOTED = {'"': "&quot;"}


def filetime_text(value: int) -> str:
    at = datetime(1601, 1, 1) + timedelta(microseconds=value // 10)
    return f"{at:%Y-%m-%dT%H:%M:%S.%f}Z"


class _Chunk:
    """Binary XML of one chunk: names and templates are found by their place in it."""

    def __init__(self, data: bytes):
        self.data, self.templates = data, {}

    def name(self, at: int) -> tuple[str, int]:
        """A name and the place behind it."""
        size = struct.unpack_from("<H", self.data, at + 6)[0]
        return self.data[at + 8 : at + 8 + 2 * size].decode("utf-16-le", "replace"), at + 10 + 2 * size

    def name_here(self, at: int) -> tuple[str, int]:
        """A name that is given by its place, which may be here."""
        where = struct.unpack_from("<I", self.data, at)[0]
        text, end = self.name(where)
        return text, end if where == at + 4 else at + 4

    def fragment(self, at: int, end: int, values: list | None) -> list:
        """Nodes (strings, or [name, attributes, children]) of the tokens from ``at``."""
        top: list = []
        open_: list[list] = []
        attribute = None

        def add(node):
            if attribute is not None:
                attribute.append(node)
            else:
                (open_[-1][2] if open_ else top).append(node)

        while at < end:
            token = self.data[at] & 0x0F
            more = self.data[at] & 0x40
            at += 1
            if token == 0x00:
                break
            if token == 0x0F:
                at += 3
            elif token == 0x01:
                at += 6 if values is not None else 4
                text, at = self.name_here(at)
                at += 4 if more else 0
                node = [text, [], []]
                (open_[-1][2] if open_ else top).append(node)
                open_.append(node)
                attribute = None
            elif token == 0x06:
                text, at = self.name_here(at)
                attribute = []
                open_[-1][1].append((text, attribute))
            elif token == 0x02:
                attribute = None
            elif token in (0x03, 0x04):
                attribute = None
                open_.pop()
            elif token in (0x05, 0x07):
                at += token == 0x05
                size = struct.unpack_from("<H", self.data, at)[0]
                add(self.data[at + 2 : at + 2 + 2 * size].decode("utf-16-le", "replace"))
                at += 2 + 2 * size
            elif token == 0x08:
                add(chr(struct.unpack_from("<H", self.data, at)[0]))
                at += 2
            elif token == 0x09:
                text, at = self.name_here(at)
                add({"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}.get(text, f"&{text};"))
            elif token in (0x0D, 0x0E):
                number = struct.unpack_from("<H", self.data, at)[0]
                at += 3
                value = values[number] if values is not None and number < len(values) else None
                for node in value if isinstance(value, list) else [] if value is None else [value]:
                    add(node)
            elif token == 0x0C:
                nodes, at = self.instance(at)
                for node in nodes:
                    add(node)
            else:
                raise ValueError(f"unknown token {token:#x} at {at - 1}")
        return top

    def instance(self, at: int) -> tuple[list, int]:
        """The nodes of a template with its values, and the place behind them."""
        where = struct.unpack_from("<I", self.data, at + 5)[0]
        at += 9
        size = struct.unpack_from("<I", self.data, where + 20)[0]
        if where == at:
            at += 24 + size
        count = struct.unpack_from("<I", self.data, at)[0]
        kinds = [struct.unpack_from("<HB", self.data, at + 4 + 4 * i) for i in range(count)]
        at += 4 + 4 * count
        values = []
        for length, kind in kinds:
            values.append(self.value(at, length, kind))
            at += length
        return self.fragment(where + 24, where + 24 + size, values), at

    def value(self, at: int, size: int, kind: int):
        data = self.data[at : at + size]
        if kind == 0x21:
            return self.fragment(at, at + size, None)
        if size == 0 or kind == 0:
            return None
        if kind & 0x80:
            return self.array(data, kind & 0x7F)
        return scalar(data, kind)

    def array(self, data: bytes, kind: int) -> str:
        if kind == 0x01:
            return ",".join(data.decode("utf-16-le", "replace").rstrip("\0").split("\0"))
        width = {0x03: 1, 0x04: 1, 0x05: 2, 0x06: 2, 0x07: 4, 0x08: 4, 0x0B: 4, 0x0D: 4, 0x14: 4, 0x0F: 16, 0x12: 16}.get(kind, 8)
        return ",".join(scalar(data[i : i + width], kind) for i in range(0, len(data) - width + 1, width))


_NUMBERS = {0x03: "<b", 0x04: "<B", 0x05: "<h", 0x06: "<H", 0x07: "<i", 0x08: "<I", 0x09: "<q", 0x0A: "<Q", 0x0B: "<f", 0x0C: "<d"}


def scalar(data: bytes, kind: int) -> str:
    """A value as text, by its type."""
    if kind == 0x01:
        return data.decode("utf-16-le", "replace").rstrip("\0")
    if kind == 0x02:
        return data.decode("cp1252", "replace").rstrip("\0")
    if kind in _NUMBERS:
        return str(struct.unpack_from(_NUMBERS[kind], data)[0])
    if kind == 0x0D:
        return "true" if any(data) else "false"
    if kind == 0x0F:
        return str(uuid.UUID(bytes_le=data)).upper()
    if kind == 0x11:
        return filetime_text(struct.unpack("<Q", data)[0])
    if kind == 0x12:
        y, m, _, d, hh, mm, ss, ms = struct.unpack("<8H", data)
        return f"{y:04}-{m:02}-{d:02}T{hh:02}:{mm:02}:{ss:02}.{ms * 1000:06}Z"
    if kind == 0x13:
        parts = struct.unpack_from(f"<{data[1]}I", data, 8)
        return "-".join(["S", str(data[0]), str(int.from_bytes(data[2:8], "big")), *map(str, parts)])
    if kind in (0x10, 0x14, 0x15):
        return f"0x{int.from_bytes(data, 'little'):x}"
    return data.hex().upper()


def _written(node, depth: int) -> str:
    name, attributes, children = node
    pad = "  " * depth
    front = "".join(f' {k}="{escape("".join(v), _QUOTED)}"' for k, v in attributes if "".join(v))
    if any(isinstance(c, list) for c in children):
        body = "".join(_written(c, depth + 1) if isinstance(c, list) else f"{'  ' * (depth + 1)}{escape(c)}\n" for c in children)
        return f"{pad}<{name}{front}>\n{body}{pad}</{name}>\n"
    text = "".join(children)
    return f"{pad}<{name}{front}>{escape(text)}</{name}>\n" if text else f"{pad}<{name}{front}>\n{pad}</{name}>\n"


def records(data: bytes) -> list[tuple[int, int, int, bytes]]:
    """(instant in ns, begin and end of the datetime, XML text) of all records, ordered by instant, then place.

    The instant is the record header's. A chunk or record that can't be read is left out; a file without the
    signature raises ValueError.
    """
    if data[:8] != FILE:
        raise ValueError("not an event log")
    found = []
    for start in range(FILE_HEADER, len(data), CHUNK_SIZE):
        if data[start : start + 8] == CHUNK:
            found += _chunk_records(data[start : start + CHUNK_SIZE])
    return sorted(found, key=lambda r: r[0])


def _chunk_records(chunk: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    xml, at, free = _Chunk(chunk), CHUNK_HEADER, struct.unpack_from("<I", chunk, 48)[0]
    out = []
    while at + 24 <= min(free or len(chunk), len(chunk)) and chunk[at : at + 4] == RECORD:
        size, _, stamp = struct.unpack_from("<IQQ", chunk, at + 4)
        if size < 28 or at + size > len(chunk):
            break
        try:
            nodes = xml.fragment(at + 24, at + size - 4, None)
            text = ('<?xml version="1.0" encoding="utf-8"?>\n' + "".join(_written(n, 0) for n in nodes if isinstance(n, list))).encode()
            begin = text.find(_BEFORE)
            begin = begin + len(_BEFORE) if begin >= 0 else 0
            out.append(((stamp - EPOCH) * 100, begin, text.find(_AFTER, begin) if begin else 0, text))
        except (ValueError, IndexError, struct.error):
            pass
        at += size
    return out
