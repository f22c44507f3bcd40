import bz2
import gzip
import io
import lzma
import random
import struct
import tarfile

import pytest

from chronoweave.operators import merge
from chronoweave import cli
from chronoweave.plans.logs import Options, plan, read_messages, search
from chronoweave.sources import bytes as bytes_source
from chronoweave.sources import files, fixed

A = "skipped\n2020-01-01 00:00:00 a\n more\n2020-01-01 00:00:02 b é\n"
B = "2020-01-01T00:00:01.5Z c\n2020-01-01T00:00:02Z d"


@pytest.fixture
def logs(tmp_path):
    (tmp_path / "a.log").write_text(A)
    (tmp_path / "b.log").write_text(B)
    return tmp_path


def _texts(df):
    return [r.text for r in df.collect()]


def test_merge_two_files(spark, logs):
    out = _texts(search(spark, [str(logs)], Options(after="20200101T000001", before="20200101T000002", file_prefix="name", dt_format="%H%M%S.%3f", dt_zone="+00:00")))
    assert out == ["b.log:000001.500:2020-01-01T00:00:01.5Z c\n", "a.log:000002.000:2020-01-01 00:00:02 b é\n", "b.log:000002.000:2020-01-01T00:00:02Z d\n"]  # the last line had no newline


def test_multi_line_prefix(spark, logs):
    out = _texts(search(spark, [str(logs / "a.log")], Options(dt_format="%Y%z", separator="--\\n")))
    assert out[0] == "2020+0000:2020-01-01 00:00:00 a\n2020+0000: more\n--\n"


def test_packed_and_wide_files_equal_plain(spark, tmp_path):
    raw = A.encode()
    (tmp_path / "a.log").write_bytes(raw)
    (tmp_path / "b.log.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "c.log.bz2").write_bytes(bz2.compress(raw))
    (tmp_path / "d.log.xz").write_bytes(lzma.compress(raw))
    for name, coding in (("e", "utf-16-le"), ("f", "utf-16-be"), ("g", "utf-32-le"), ("h", "utf-32-be")):
        (tmp_path / f"{name}.log").write_bytes(("﻿" + A).encode(coding))
    listed = files.list_files(spark, [str(tmp_path)])
    found = {}
    for r in read_messages(spark, listed).collect():
        found.setdefault(r.path_id, []).append((r.seq, r.epoch_ns, r.n_lines, bytes(r.raw).decode()))
    assert len(found) == 8
    assert all(sorted(v) == sorted(found[0]) for v in found.values())


def _tar(path, **entries):
    with tarfile.open(path, "w") as tar:
        for name, data in entries.items():
            info = tarfile.TarInfo(name.replace("_", "/", 1).replace("_", "."))
            info.size, info.mtime = len(data), 1600000000
            tar.addfile(info, io.BytesIO(data))


def test_tar_entries_are_files_of_their_own(spark, tmp_path):
    _tar(tmp_path / "logs.tar", x_a_log=b"2020-01-05 00:00:00 a1\n2020-01-06 00:00:00 a2\n", x_b_log=b"undated\n2020-01-01 00:00:00 b1\n2020-01-02 00:00:00 b2\n", x_c_log_gz=b"123456789", x_d_log=b"")
    listed = files.list_files(spark, [str(tmp_path / "logs.tar")])
    assert [(f["path_id"], f["subpath"], f["status"]) for f in listed] == [(0, "x/a.log", "ok"), (1, "x/b.log", "ok"), (2, "x/c.log.gz", "unsupported"), (3, "x/d.log", "empty")]
    out = _texts(search(spark, [str(tmp_path / "logs.tar")], Options(file_prefix="path")))
    assert [t.split("|", 1)[1] for t in out] == [
        "x/b.log:2020-01-01 00:00:00 b1\n", "x/b.log:2020-01-02 00:00:00 b2\n", "x/a.log:2020-01-05 00:00:00 a1\n", "x/a.log:2020-01-06 00:00:00 a2\n",
    ]


def test_other_inputs_do_not_change_a_file(spark, tmp_path):
    mixed = "".join(f"2020-01-01 00:00:{i % 60:02} a\n" for i in range(2000)) + "Jan  3 00:00:00 2020 x\n[29-08-24 13:17:25] y\n"
    (tmp_path / "m.log").write_text(mixed)
    _tar(tmp_path / "t.tar", a_log=b"Jan  3 00:00:00 2020 x\n[29-08-24 13:17:25] y\n")
    alone = read_messages(spark, files.list_files(spark, [str(tmp_path / "m.log")])).count()
    both = read_messages(spark, files.list_files(spark, [str(tmp_path / "m.log"), str(tmp_path / "t.tar")]))
    assert both.where("path_id = 0").count() == alone == 2001


def test_bad_files_do_not_end_a_search(spark, logs, tmp_path):
    (tmp_path / "bad.log.gz").write_bytes(gzip.compress(A.encode())[:-12])
    (tmp_path / "worse.log.gz").write_bytes(b"no gzip at all")
    (tmp_path / "x.etl").write_bytes(b"0123456789")
    (tmp_path / "zero.log").write_bytes(bytes(200))
    (tmp_path / "ff.log").write_bytes(b"\xff" * 200)
    (tmp_path / "prose.log").write_text("just words\n" * 3)
    (tmp_path / "j.journal").write_bytes(b"no journal at all")
    found = plan(spark, [str(tmp_path), str(tmp_path / "missing.log")])
    assert _texts(found.rendered()) == _texts(search(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log")]))
    status = {r.shown.rsplit("/", 1)[-1]: r.status for r in found.errors().collect()}
    assert status == {
        "bad.log.gz": "corrupt", "worse.log.gz": "unreadable", "x.etl": "unsupported", "zero.log": "null_bytes", "ff.log": "ff_bytes", "prose.log": "no_messages", "j.journal": "corrupt", "missing.log": "not_found",
    }


def test_final_newline_comes_after_the_separator(spark, logs):
    assert _texts(search(spark, [str(logs / "b.log")], Options(separator="|")))[-1] == "2020-01-01T00:00:02Z d|\n"


def test_gzip_header_gives_the_year(spark, tmp_path):
    path = tmp_path / "old.log.gz"
    path.write_bytes(gzip.compress(b"Dec 31 10:00:00 h c\nJan  2 00:00:00 h d\n", mtime=1612137600))
    assert [t[:8] for t in _texts(search(spark, [str(path)], Options(dt_format="%Y%m%d", dt_zone="+00:00")))] == ["20201231", "20210102"]


def test_lz4_frames(spark, tmp_path):
    raw = A.encode()
    # a block with a match: "abcabcabcabc", then an uncompressed block
    block = bytes([0x35]) + b"abc" + b"\x03\x00" + bytes([0x00])
    frame = b"\x04\x22\x4d\x18\x40\x40\x00" + len(block).to_bytes(4, "little") + block + (len(raw) | 1 << 31).to_bytes(4, "little") + raw + bytes(4)
    assert bytes_source.lz4_frames(frame) == b"abc" * 4 + raw
    (tmp_path / "a.log.lz4").write_bytes(b"\x04\x22\x4d\x18\x40\x40\x00" + (len(raw) | 1 << 31).to_bytes(4, "little") + raw + bytes(4))
    assert len(_texts(search(spark, [str(tmp_path / "a.log.lz4")]))) == 2


def test_compat_profile_tries_the_most_used_pattern_first():
    head = b"20220101 000001 a\n2022-01-02 00:00:02 -08:00 b\n2022-01-03 00:00:03 c\n"
    clean, status = bytes_source.head_profile(head, "utf-8", False)
    assert status == "ok" and len(clean) == 2 and bytes_source.head_profile(b"words\n", "utf-8", False) == (None, "no_messages")
    assert len(bytes_source.head_profile(head, "utf-8", False, "compat")[0]) == 2


def test_colour_and_alignment(spark, tmp_path):
    (tmp_path / "a.log").write_text("2020-01-01 00:00:00 x\n")
    (tmp_path / "日本.log").write_text("2020-01-01 00:00:01 y\n")
    (tmp_path / "long name without messages.log").write_text("words only\n")
    out = _texts(search(spark, [str(tmp_path)], Options(file_prefix="name", file_align=True, theme="dark")))
    assert out[0].startswith("a.log   :\x1b[38;5;118m\x1b[4m2020-01-01 00:00:00\x1b[24m x\x1b[0m\n") and out[1].startswith("日本.log:\x1b[38;5;")


def test_year_is_inferred_backwards(spark, tmp_path):
    path = tmp_path / "syslog"
    path.write_text("Dec 31 23:59:59 h a\nFeb 29 00:00:00 h b\nDec 31 10:00:00 h c\nJan  2 00:00:00 h d\n")
    out = _texts(search(spark, [str(path)], Options(dt_format="%Y%m%d", dt_zone="+00:00"), mtimes={str(path): 1612137600}))
    assert [t[:8] for t in out] == ["20191231", "20200229", "20201231", "20210102"]


def test_refused_files(spark, tmp_path):
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "tiny.log").write_bytes(b"abc")
    (tmp_path / "x.png").write_bytes(b"0123456789")
    assert [f["status"] for f in files.list_files(spark, [str(tmp_path)])] == ["empty", "too_small", "unparsable"]


@pytest.mark.parametrize(
    ("name", "kind", "archive"),
    [
        ("syslog", "text", "normal"), ("syslog.1", "text", "normal"), ("a.log.gz", "text", "gz"), ("a.log.old", "text", "normal"), ("wtmp", "fixed:utmp", "normal"),
        ("log.utmp.1", "fixed:utmp", "normal"), ("user.journal.xz", "journal", "xz"), ("x.evtx", "evtx", "normal"), ("x.odlgz", "odl", "normal"), ("x.loggz", "text", "gz"),
        ("logs.tar", "tar", "normal"), ("picture.png", "text", "normal"), ("~a.log~", "text", "normal"), ("unknown", "text", "normal"), ("lastlog", "fixed:lastlog", "normal"),
    ],
)
def test_file_type(name, kind, archive):
    found = files.file_type(name)
    assert (found.kind, found.archive) == (kind, archive)


def _utmpx(seconds, micros, user):
    data = bytearray(384)
    struct.pack_into("<h2xi32s4s32s256s", data, 0, 7, 42, b"tty1", b"1", user, b"host")
    struct.pack_into("<ii", data, 340, seconds, micros)
    return bytes(data)


def test_records(spark, tmp_path):
    data = _utmpx(1600000010, 5, b"x" * 32) + bytes(384) + _utmpx(1600000000, 0, b"root") + _utmpx(1600000010, 5, b"last")
    (tmp_path / "wtmp").write_bytes(data)
    listed = files.list_files(spark, [str(tmp_path / "wtmp")])
    rows = sorted(fixed.read_records(spark, listed).collect(), key=lambda r: r.seq)
    assert [r.epoch_ns for r in rows] == [1600000000 * 10**9, 1600000010 * 10**9 + 5000, 1600000010 * 10**9 + 5000]
    assert rows[0].layout == "linux_x86_utmpx" and b"ut_type USER_PROCESS ut_pid 42" in bytes(rows[0].raw) and b"ut_user 'root'" in bytes(rows[0].raw)
    assert len(fixed.read_records(spark, listed, dedup_times=True).collect()) == 2


def test_merge_key_equals_a_head_by_head_merge(spark):
    rng = random.Random(7)
    sources = {p: [rng.randrange(12) for _ in range(rng.randrange(1, 40))] for p in range(4)}
    heads, want = dict.fromkeys(sources, 0), []
    while live := [p for p in sources if heads[p] < len(sources[p])]:
        p = min(live, key=lambda q: (sources[q][heads[q]], q))
        want.append((p, heads[p]))
        heads[p] += 1
    rows = [(p, i, v) for p, values in sources.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "path_id int, seq long, epoch_ns long")
    got = merge.with_merge_key(df, block=4).orderBy("merge_key", "path_id", "seq").collect()
    assert [(r.path_id, r.seq) for r in got] == want


def test_file_over_many_splits_keeps_its_order(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("".join(f"2020-01-01 {i // 3600:02}:{i // 60 % 60:02}:{i % 60:02} n{i}\n tail {i}\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    try:
        rows = sorted(read_messages(spark, files.list_files(spark, [str(path)])).collect(), key=lambda r: r.seq)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [bytes(r.raw).decode().split(" tail ")[1] for r in rows] == [f"{i}\n" for i in range(2000)]
    assert [r.n_lines for r in rows] == [2] * 2000


def test_command_line(spark, logs, monkeypatch):
    out, err = io.StringIO(), io.StringIO()
    monkeypatch.setenv("CHRONOWEAVE_AFTER", "20200101T000001")
    args = ["-", "-t", "+00:00", "--prepend-utc", "-d", "%H%M%S", "-n", "--summary", "-c", "never", "-"]
    code = cli.main(args, spark, [f"{logs}/a.log\n", f"{logs}/none.log\n"], out, err)
    assert code == 1 and out.getvalue() == "a.log:000002:2020-01-01 00:00:02 b é\n"
    said = err.getvalue()
    assert "none.log: not_found" in said and "standard input was given more than once" in said
    assert "processed 2, first 2020-01-01 00:00:00.000 +00:00" in said and "printed 1," in said and "Datetime after         : 2020-01-01 00:00:01.000 +00:00" in said
    assert cli.main(["x", "-u", "-l"], spark, [], out, err) == 1
    assert cli.main([f"{logs}/a.log", "-a", "nonsense"], spark, [], out, err) == 1
