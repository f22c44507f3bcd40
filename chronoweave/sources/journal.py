"""Journal files: entries of systemd's public journal file format, in the order of the file's entry arrays."""

from __future__ import annotations

import lzma
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from chronoweave.sources.bytes import lz4_block

# Fixed values of the format: signature, object types, flags of compressed payloads, and of compact files.
SIGNATURE = b"LPKSHHRH"
DATA, ENTRY, ENTRY_ARRAY = 1, 3, 6
XZ, LZ4, ZSTD = 1, 2, 4
COMPACT = 1 << 4
ENTRIES = "path_id int, seq long, realtime_us long, monotonic_us long, cursor string, high_us long, keys array<string>, values array<binary>"


def _payload(data: bytes, at: int, compact: bool) -> bytes:
    kind, flags, size = data[at], data[at + 1], struct.unpack_from("<Q", data, at + 8)[0]
    if kind != DATA or at + size > len(data):
        raise ValueError(f"no data object at {at}")
    body = data[at + (72 if compact else 64) : at + size]
    if flags & XZ:
        return lzma.decompress(body)
    if flags & ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    if flags & LZ4:
        out = bytearray()
        lz4_block(body[8:], out)
        return bytes(out)
    return body


def entries(data: bytes) -> Iterator[tuple[int, int, str, list[tuple[bytes, bytes]]]]:
    """(realtime µs, monotonic µs, cursor, fields) of a file's entries; a field without ``=`` has an empty value.

    A file that isn't a journal raises ValueError; entries end where the file is cut off.
    """
    if data[:8] != SIGNATURE or len(data) < 208:
        raise ValueError("not a journal file")
    compact = bool(struct.unpack_from("<I", data, 12)[0] & COMPACT)
    seqnum_id, array = data[72:88].hex(), struct.unpack_from("<Q", data, 176)[0]
    item, width = ("<I", 4) if compact else ("<Q", 8)
    seen: dict[int, bytes] = {}
    arrays = set()
    while array and array + 24 <= len(data) and array not in arrays:
        arrays.add(array)
        size, following = struct.unpack_from("<QQ", data, array + 8)
        for place in range(array + 24, min(array + size, len(data) - width + 1), width):
            at = struct.unpack_from(item, data, place)[0]
            if at == 0:
                break
            if at + 64 > len(data) or data[at] != ENTRY:
                return
            size_of, seqnum, realtime, monotonic = struct.unpack_from("<QQQQ", data, at + 8)
            boot, checksum = data[at + 40 : at + 56].hex(), struct.unpack_from("<Q", data, at + 56)[0]
            fields = []
            for ref in range(at + 64, min(at + size_of, len(data) - width + 1), 4 if compact else 16):
                where = struct.unpack_from(item, data, ref)[0]
                if where and where not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[where] = _payload(data, where, compact)
                if where:
                    key, _, value = seen[where].partition(b"=")
                    fields.append((key, value))
            yield realtime, monotonic, f"s={seqnum_id};i={seqnum:x};b={boot};m={monotonic:x};t={realtime:x};x={checksum:x}", fields
        array = following


def read_entries(spark: SparkSession, files: list[dict]) -> DataFrame:
    """``ENTRIES`` of all files; seq from 1, high_us is the latest time of the file so far."""
    from chronoweave.sources.text import BROKEN, by_path, contents, whole_files

    how = by_path(files)
    columns = [c.split()[0] for c in ENTRIES.split(", ")]

    def read(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                for f, data, _ in contents(how, path, bytes(content)):
                    rows, high = [], 0
                    try:
                        for realtime, monotonic, cursor, fields in entries(data or b""):
                            high = max(high, realtime)
                            rows.append((f["path_id"], len(rows) + 1, realtime, monotonic, cursor, high, [k.decode("utf-8", "replace") for k, _ in fields], [v for _, v in fields]))
                    except (*BROKEN, struct.error):
                        pass  # what was read before the damage stays; errors.read_errors has the reason
                    for start in range(0, len(rows), 4096):
                        yield pd.DataFrame(rows[start : start + 4096], columns=columns)

    return whole_files(spark, files).mapInPandas(read, ENTRIES)


def highest(values) -> np.ndarray:
    """The running maximum of datetimes: the merge key of a file's messages."""
    return np.maximum.accumulate(np.asarray(values, np.int64)) if len(values) else np.zeros(0, np.int64)
