"""Bytes of files: packed forms, tar entries, encodings, lines, and what a file's head tells of its patterns."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zlib
from collections import Counter
from collections.abc import Iterator

from chronoweave.functions import patterns

_MARKS = [(b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
#: A head of fewer bytes needs one line and one message; a longer one three lines and two messages.
SMALL_HEAD = 8096
KEPT_PATTERNS = 2


def lz4_block(data: bytes, out: bytearray) -> None:
    """Appends the bytes of one LZ4 block (public block format) to ``out``, which holds what came before it."""
    at, n = 0, len(data)
    while at < n:
        token = data[at]
        at += 1
        size = token >> 4
        if size == 15:
            while True:
                size += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        out += data[at : at + size]
        at += size
        if at >= n:
            return
        back = data[at] | data[at + 1] << 8
        at += 2
        size = token & 15
        if size == 15:
            while True:
                size += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        size += 4
        start = len(out) - back
        if back == 0 or start < 0:
            raise ValueError("an LZ4 block refers to bytes before its beginning")
        while size > 0:  # a copy may overlap itself
            part = out[start : start + size]
            out += part
            size -= len(part)
            start += len(part)


def lz4_frames(data: bytes) -> bytes:
    """The content of LZ4 frames (public frame format); checksums aren't verified."""
    out, at = bytearray(), 0
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # skippable
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        if magic != 0x184D2204:
            raise ValueError("not an LZ4 frame")
        flags = data[at + 4]
        at += 7 + (8 if flags & 8 else 0) + (4 if flags & 1 else 0)
        while (size := int.from_bytes(data[at : at + 4], "little")) != 0:
            at += 4
            body = data[at : at + (size & 0x7FFFFFFF)]
            if len(body) < size & 0x7FFFFFFF:
                raise EOFError("an LZ4 frame ends early")
            if size >> 31:
                out += body
            else:
                lz4_block(body, out)
            at += len(body) + (4 if flags & 16 else 0)
        at += 4 + (4 if flags & 4 else 0)
    return bytes(out)


def unpacked(content: bytes, archive: str, single_member: bool = False) -> bytes:
    """The bytes that a packed file holds; ``single_member`` reads the first gzip or xz stream only."""
    if archive == "gz":
        return zlib.decompressobj(31).decompress(content) if single_member else gzip.decompress(content)
    if archive == "bz2":
        return bz2.decompress(content)
    if archive == "xz":
        return lzma.LZMADecompressor().decompress(content) if single_member else lzma.decompress(content)
    return lz4_frames(content) if archive == "lz4" else content


def partly_unpacked(head: bytes, archive: str) -> bytes:
    """What the first bytes of a packed file give, as far as they reach."""
    if archive == "gz":
        return zlib.decompressobj(31).decompress(head)
    if archive == "bz2":
        return bz2.BZ2Decompressor().decompress(head)
    if archive == "xz":
        return lzma.LZMADecompressor().decompress(head)
    if archive == "lz4":
        try:
            return lz4_frames(head)
        except (EOFError, IndexError):
            return _first_lz4_blocks(head)
    return head


def _first_lz4_blocks(head: bytes) -> bytes:
    if head[:4] != b"\x04\x22\x4d\x18":
        raise ValueError("not an LZ4 frame")
    out, at = bytearray(), 7 + (8 if head[4] & 8 else 0) + (4 if head[4] & 1 else 0)
    size = int.from_bytes(head[at : at + 4], "little")
    body = head[at + 4 : at + 4 + (size & 0x7FFFFFFF)]
    if size >> 31:
        return body
    try:
        lz4_block(body, out)
    except IndexError:
        pass
    return bytes(out)


def tar_entries(content: bytes, archive: str) -> Iterator[tuple[str, bytes, float]]:
    """(name, bytes, mtime) of the regular entries of a tar file."""
    with tarfile.open(fileobj=io.BytesIO(unpacked(content, archive))) as members:
        for entry in members:
            if entry.isfile():
                yield entry.name, members.extractfile(entry).read(), float(entry.mtime)


def encoding_of(head: bytes) -> tuple[str, int]:
    """Encoding and length of the byte order mark, from a file's first bytes."""
    for mark, name in _MARKS:
        if head.startswith(mark):
            return name, len(mark)
    head = head[: len(head) // 4 * 4]
    if head and 0 in head:
        quarter = [sum(b == 0 for b in head[i::4]) / (len(head) / 4) for i in range(4)]
        zero = [q > 0.6 for q in quarter]
        shapes = {(False, True, True, True): "utf-32-le", (True, True, True, False): "utf-32-be", (False, True, False, True): "utf-16-le", (True, False, True, False): "utf-16-be"}
        if tuple(zero) in shapes:
            return shapes[tuple(zero)], 0
    return "utf-8", 0


def split_lines(content: bytes, encoding: str | None = None) -> list[bytes]:
    """UTF-8 lines, each with its newline but maybe the last; undecodable parts become U+FFFD unless the text is UTF-8."""
    found, mark = encoding_of(content[:8192])
    content = content[mark:]
    encoding = encoding or found
    if encoding != "utf-8":
        content = content.decode(encoding, "replace").encode()
    parts = content.split(b"\n")
    return [p + b"\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def head_profile(head: bytes, encoding: str, cut: bool, profile: str = "clean") -> tuple[list[int] | None, str]:
    """The pattern ids a file keeps, in the order to try, and its status; ``cut`` says that the file goes on.

    ``clean`` keeps the two most specific patterns (lowest ids) that are a head line's first. ``compat`` keeps
    at most two of those seen up to the first two or three datetime lines, tries the most used first,
    and so may take a less specific one.
    """
    lines = head.decode(encoding, "replace").split("\n")
    if cut and len(lines) > 1:
        lines = lines[:-1]
    large = len(head) >= SMALL_HEAD
    if len([x for x in lines if x]) < (3 if large else 1):
        return None, "no_lines"
    need, used, messages = (2 if large else 1), Counter(), 0
    for line in lines:
        order = patterns.FAMILIES
        if profile == "compat":
            order = sorted(order, key=lambda f: (-used[f.id], f.id))
            if messages > need:
                break
        found = patterns.first_family(line, order)
        if found:
            used[found.id] += 1
            messages += 1
    if messages < need:
        return None, "no_messages"
    kept = sorted(used)[:KEPT_PATTERNS]
    return (sorted(kept, key=lambda i: (-used[i], i)) if profile == "compat" else kept), "ok"
