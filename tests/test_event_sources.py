"""Readers of journals, event logs and system log databases, on files written here after the public format descriptions."""

import lzma
import struct

import pytest

from chronoweave.operators import journal as journal_operators
from chronoweave.plans.logs import Options, plan, search
from chronoweave.sources import asl, evtx, journal


def make_journal(entries, compact=False, packed=False):
    """A journal of (realtime, monotonic, fields) entries; values over 40 bytes are packed with ``packed``."""
    out = bytearray(272)
    item = "<I" if compact else "<Q"

    def put(kind, flags, body):
        while len(out) % 8:
            out.append(0)
        at = len(out)
        out.extend(struct.pack("<BB6xQ", kind, flags, 16 + len(body)) + body)
        return at

    def data(field):
        flags = journal.XZ if packed and len(field) > 40 else 0
        return put(journal.DATA, flags, bytes(48 + (8 if compact else 0)) + (lzma.compress(field) if flags else field))

    places = []
    for n, (realtime, monotonic, fields) in enumerate(entries, 1):
        refs = [data(f) for f in fields]
        items = b"".join(struct.pack(item, r) + (b"" if compact else bytes(8)) for r in refs)
        places.append(put(journal.ENTRY, 0, struct.pack("<QQQ", n, realtime, monotonic) + bytes(range(16)) + struct.pack("<Q", 255) + items))
    half = len(places) // 2
    second = put(journal.ENTRY_ARRAY, 0, struct.pack("<Q", 0) + b"".join(struct.pack(item, p) for p in places[half:]) + bytes(8))
    first = put(journal.ENTRY_ARRAY, 0, struct.pack("<Q", second) + b"".join(struct.pack(item, p) for p in places[:half]))
    out[:16] = journal.SIGNATURE + struct.pack("<II", 0, journal.COMPACT if compact else 0)
    out[72:88] = bytes(16)
    out[88:96], out[176:184] = struct.pack("<Q", 272), struct.pack("<Q", first)
    return bytes(out)


ENTRIES = [
    (1_600_000_000_000_001, 5_000_000, [b"_HOSTNAME=h", b"SYSLOG_IDENTIFIER=sshd", b"_PID=7", b"MESSAGE=one"]),
    (1_600_000_002_000_000, 6_500_000, [b"_HOSTNAME=h", b"_COMM=cron", b"SYSLOG_PID=8", b"MESSAGE=" + b"two " * 20, b"ZED=z"]),
    (1_600_000_001_000_000, 7_000_000, [b"MESSAGE=three\nlines"]),
]


@pytest.mark.parametrize(("compact", "packed"), [(False, False), (True, False), (False, True)])
def test_journal_entries(compact, packed):
    found = list(journal.entries(make_journal(ENTRIES, compact, packed)))
    assert [(r, m, [k + b"=" + v for k, v in f]) for r, m, _, f in found] == ENTRIES
    assert found[0][2] == "s=" + "0" * 32 + ";i=1;b=000102030405060708090a0b0c0d0e0f;m=4c4b40;t=5af3107a4000".replace("5af3107a4000", f"{ENTRIES[0][0]:x}") + ";x=ff"


def test_journal_search(spark, tmp_path):
    (tmp_path / "u.journal").write_bytes(make_journal(ENTRIES))
    (tmp_path / "v.journal.xz").write_bytes(lzma.compress(make_journal(ENTRIES[:1])))
    read = lambda **o: [r.text for r in search(spark, [str(tmp_path / "u.journal")], Options(**o)).collect()]
    assert read() == ["Sep 13 12:26:40 h sshd[7]: one\n", "Sep 13 12:26:42 h cron[8]: " + "two " * 20 + "\n", "Sep 13 12:26:41: three\nlines\n"]
    assert read(journal_output="short-monotonic")[0] == "[    5.000000] h sshd[7]: one\n"
    assert read(journal_output="cat", before="+1600000002") == ["one\n", "two " * 20 + "\n", "three\nlines\n"]
    assert read(journal_output="cat", before="+1600000002", journal_before_exclusive=True) == ["one\n"]
    assert read(journal_output="export")[0].splitlines()[1:4] == ["__REALTIME_TIMESTAMP=1600000000000001", "__MONOTONIC_TIMESTAMP=5000000", "_HOSTNAME=h"]
    verbose = read(journal_output="verbose")[1].splitlines()
    assert verbose[0].startswith("Sun 2020-09-13 12:26:42.000000 +00:00 [s=") and [x.split("=")[0].strip() for x in verbose[1:]] == ["_HOSTNAME", "_COMM", "MESSAGE", "SYSLOG_PID", "__MONOTONIC_TIMESTAMP", "ZED"]
    assert len(search(spark, [str(tmp_path)]).collect()) == 4
    with pytest.raises(ValueError):
        journal_operators.journal_text(spark.createDataFrame([], journal.ENTRIES), "json", 0)


def test_monotonic_times_beyond_the_padding_are_whole(spark):
    rows = [(0, 99999_999999, [], []), (0, 100005_000001, [], []), (0, 12_345678_000009, [], [])]
    made = journal_operators.journal_text(spark.createDataFrame(rows, "realtime_us long, monotonic_us long, keys array<string>, values array<binary>"), "short-monotonic", 0)
    out = [(bytes(r.raw).decode(), bytes(r.raw)[r.dt_beg : r.dt_end].decode()) for r in made.orderBy("monotonic_us").collect()]
    assert out == [("[99999.999999]\n", "99999.999999"), ("[100005.000001]\n", "100005.000001"), ("[12345678.000009]\n", "12345678.000009")]


def _name(text):
    return struct.pack("<IHH", 0, 0, len(text)) + text.encode("utf-16-le") + bytes(2)


def make_evtx(records):
    """An event log of (FILETIME, event id, computer) records: the first has its template with it, the others refer to it."""
    chunk = bytearray(evtx.CHUNK_SIZE)
    at, template = evtx.CHUNK_HEADER, None
    for n, (stamp, event, computer) in enumerate(records, 1):
        body = bytearray(b"\x0f\x01\x01\x00\x0c\x01" + struct.pack("<I", 1))
        base = at + 24
        here = base + len(body) + 4
        if template is None:
            template = here
            inner = bytearray()

            def open_tag(name, attributes=False):
                inner.extend(struct.pack("<BHI", 0x41 if attributes else 0x01, 0xFFFF, 0))
                place = template + 24 + len(inner) + 4
                inner.extend(struct.pack("<I", place) + _name(name))
                if attributes:
                    inner.extend(bytes(4))

            def attribute(name):
                place = template + 24 + len(inner) + 5
                inner.extend(b"\x06" + struct.pack("<I", place) + _name(name))

            inner.extend(b"\x0f\x01\x01\x00")
            open_tag("Event", True)
            attribute("xmlns")
            inner.extend(b"\x05\x01" + struct.pack("<H", 1) + "u".encode("utf-16-le") + b"\x02")
            open_tag("EventID")
            inner.extend(b"\x02\x0d" + struct.pack("<HB", 0, 6) + b"\x04")
            open_tag("TimeCreated", True)
            attribute("SystemTime")
            inner.extend(b"\x0e" + struct.pack("<HB", 1, 0x11) + b"\x03")
            open_tag("Computer")
            inner.extend(b"\x02\x0d" + struct.pack("<HB", 2, 1) + b"\x04\x04\x00")
            body += struct.pack("<I", template) + struct.pack("<I16sI", 0, bytes(16), len(inner)) + inner
        else:
            body += struct.pack("<I", template)
        name = computer.encode("utf-16-le")
        body += struct.pack("<I", 3) + struct.pack("<HBx", 2, 6) + struct.pack("<HBx", 8, 0x11) + struct.pack("<HBx", len(name), 1)
        body += struct.pack("<HQ", event, stamp) + name + b"\x00"
        size = 24 + len(body) + 4
        chunk[at : at + size] = evtx.RECORD + struct.pack("<IQQ", size, n, stamp) + body + struct.pack("<I", size)
        at += size
    chunk[:8] = evtx.CHUNK
    chunk[48:52] = struct.pack("<I", at)
    return evtx.FILE + bytes(evtx.FILE_HEADER - 8) + bytes(chunk)


def test_event_log(spark, tmp_path):
    at = evtx.EPOCH + 1_600_000_000 * 10**7
    (tmp_path / "s.evtx").write_bytes(make_evtx([(at + 20, 2, "b & c"), (at, 1, "a"), (at + 20, 3, "")]))
    found = search(spark, [str(tmp_path / "s.evtx")]).collect()
    assert [r.epoch_ns for r in found] == [1_600_000_000 * 10**9, *[1_600_000_000 * 10**9 + 2000] * 2]
    assert found[1].text == (
        '<?xml version="1.0" encoding="utf-8"?>\n<Event xmlns="u">\n  <EventID>2</EventID>\n  <TimeCreated SystemTime="2020-09-13T12:26:40.000002Z">\n  </TimeCreated>\n  <Computer>b &amp; c</Computer>\n</Event>\n'
    )
    assert found[1].text.encode()[found[1].dt_beg : found[1].dt_end] == b"2020-09-13T12:26:40.000002Z"
    assert [r.text.split("EventID>")[1][0] for r in search(spark, [str(tmp_path / "s.evtx")], Options(before="+1600000000")).collect()] == ["1"]
    assert evtx.scalar(bytes([1, 1, 0, 0, 0, 0, 0, 5, 18, 0, 0, 0]), 0x13) == "S-1-5-18" and evtx.scalar(b"\x10\0\0\0", 0x14) == "0x10"


def make_asl(records):
    out = bytearray(80)

    def text(value):
        raw = value.encode()
        if not raw:
            return 0
        if len(raw) <= 7:
            return int.from_bytes(bytes([0x80 | len(raw)]) + raw.ljust(7, b"\0"), "big")
        at = len(out)
        out.extend(b"\0\1" + struct.pack(">I", len(raw) + 1) + raw + b"\0")
        return at

    places = []
    for n, (seconds, nanos, host, message, pairs) in enumerate(records, 1):
        refs = [text(x) for x in (host, "sender", "daemon", message, "", "")]
        keys = [text(x) for pair in pairs for x in pair]
        places.append(len(out))
        out.extend(asl._RECORD.pack(114 + 8 * len(keys) + 8, 0, n, seconds, nanos, 3, 0, 42, 0, 20, 1, 2, 0, len(keys), *refs) + struct.pack(f">{len(keys)}Q", *keys) + bytes(8))
    for here, following in zip(places, places[1:]):
        out[here + 6 : here + 14] = struct.pack(">Q", following)
    out[:12] = asl.SIGNATURE
    out[12:45] = struct.pack(">IQqIBQ", 2, places[0], 0, 256, 0, places[-1])
    return bytes(out)


def test_system_log_database(spark, tmp_path):
    (tmp_path / "x.asl").write_bytes(make_asl([(1_600_000_000, 123_456_789, "host", "a longer message", [("Key", "a longer value")]), (1_600_000_005, 0, "", "m", [])]))
    found = search(spark, [str(tmp_path / "x.asl")]).collect()
    assert found[0].text == (
        "2020-09-13T12:26:40.123456  id=1  level=Error  pid=42  gid=20  read_uid=1  read_gid=2  host=host  sender=sender  facility=daemon  message='a longer message'  Key=a longer value\n"
    )
    assert found[0].epoch_ns == 1_600_000_000_123_000_000 and found[0].text[found[0].dt_beg : found[0].dt_end] == "2020-09-13T12:26:40.123456"
    assert len(found) == 2 and len(plan(spark, [str(tmp_path)], Options(after="+1600000001")).messages().collect()) == 1
