"""Paths to files: listing, type by name, status."""

from __future__ import annotations

import lzma
import re
import tarfile
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.sources.bytes import encoding_of, head_profile, partly_unpacked, tar_entries

#: Bytes at a file's beginning that decide its encoding and patterns, and the bytes of all heads together.
HEAD_BYTES, ALL_HEADS = 0xFFFF, 256 << 20
#: Files of at most this many bytes hold no message.
TOO_SMALL = 5
#: Kinds that need libraries which aren't public format descriptions; they are listed, not read.
UNSUPPORTED = ("etl", "odl")

# Names and suffixes that decide a file's type.
TEXT_SUFFIXES = ["log", "txt", "text"]
TEXT_NAMES = ["dmesg", "history", "kernellog", "kernelog", "kernlog", "log", "messages", "syslog"]
RECORD_NAMES = {
    "btmp": "utmp", "utmp": "utmp", "wtmp": "utmp",
    "btmpx": "utmpx", "utmpx": "utmpx", "wtmpx": "utmpx",
    "lastlog": "lastlog", "lastlogx": "lastlogx", "acct": "acct", "pacct": "acct_v3",
}
ARCHIVES = {"bz2": "bz2", "gz": "gz", "gzip": "gz", "lz4": "lz4", "xz": "xz", "xzip": "xz"}
EVENT_SUFFIXES = ["asl", "etl", "evtx", "journal"]
ODL_SUFFIXES = ["odl", "aodl", "odlgz", "odlsent"]
NOT_LOGS = (
    "7z a aac aux avi bat bin bmp bz c cat class cpp cmd diagpkg dll ear exe flac flv gif h hpp htm html ico jar java "
    "jpeg jpg lib m4b m4p m4r m4v mkv mov mp3 mp4 msi mui o ogg opus pl png ps1 psd1 py rb sh so svg sys tif tiff ttf "
    "tgz war wav webm webp wma wmv zip"
).split()


@dataclass(frozen=True)
class FileType:
    """``kind``: text, fixed:<layout family>, asl, etl, evtx, journal, odl, tar or unparsable."""

    kind: str
    archive: str = "normal"
    encoding: str | None = None


def file_type(name: str, named_directly: bool = True) -> FileType:
    """Type of a base name. A non-log suffix is text when the file was named directly."""
    archive = "normal"
    name = name.strip("~-,?;").lstrip(".").lower()
    while True:
        stem, dot, suffix = name.rpartition(".")
        if not dot or not stem:
            return FileType(_bare(name), archive)
        if suffix in ARCHIVES:
            archive = ARCHIVES[suffix]
        elif suffix == "loggz":
            return FileType("text", "gz", "UTF-16LE")
        elif suffix in EVENT_SUFFIXES:
            return FileType(suffix, archive)
        elif suffix in ODL_SUFFIXES:
            return FileType("odl", archive)
        elif suffix == "tar":
            return FileType("tar", archive)
        elif suffix in TEXT_SUFFIXES:
            return FileType("text", archive)
        elif suffix in RECORD_NAMES:
            return FileType(f"fixed:{RECORD_NAMES[suffix]}", archive)
        elif suffix in NOT_LOGS:
            return FileType("text" if named_directly else "unparsable", archive)
        # Numbers and unknown suffixes are dropped.
        name = stem.strip("~-,?;")


def _bare(name: str) -> str:
    if name in RECORD_NAMES:
        return f"fixed:{RECORD_NAMES[name]}"
    if name in EVENT_SUFFIXES:
        return name
    return "text"


def classified(names: DataFrame, column: str = "name") -> DataFrame:
    """``names`` with file_type and archive of each base name; a name is decided once, however often it occurs."""

    def decide(frames):
        for pdf in frames:
            kinds = [file_type(n.rsplit("/", 1)[-1]) for n in pdf["_name"]]
            yield pdf.assign(file_type=[k.kind for k in kinds], archive=[k.archive for k in kinds])

    each = names.select(F.col(column).alias("_name")).where("_name is not null").distinct().mapInPandas(decide, "_name string, file_type string, archive string")
    return names.join(each, F.col(column) == F.col("_name"), "left").drop("_name")


class Tree:
    """The file system of a path, through the session's own configuration; local files are read directly."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def below(self, given: str) -> tuple[bool, list[tuple[str, int, float]]]:
        """Whether ``given`` names a file, and (path, size, mtime) of all files below it, sorted by path."""
        root = self.jvm.org.apache.hadoop.fs.Path(given)
        fs = root.getFileSystem(self.conf)
        top = fs.getFileStatus(fs.resolvePath(root))
        found = []
        if top.isFile():
            found.append(top)
        else:
            each = fs.listFiles(top.getPath(), True)
            while each.hasNext():
                found.append(each.next())
        rows = [(s.getPath().toString(), s.getLen(), s.getModificationTime() / 1000) for s in found]
        return top.isFile(), sorted(rows)

    def ends(self, path: str, size: int) -> tuple[bytes, bytes]:
        """The first ``size`` bytes of a file, and its last byte."""
        if path.startswith("file:"):
            with open(unquote(urlparse(path).path), "rb") as f:
                head = f.read(size)
                f.seek(0, 2)
                f.seek(max(0, f.tell() - 1))
                return head, f.read(1)
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.conf)
        stream = fs.open(at)
        try:
            io = self.jvm.org.apache.commons.io
            head = bytes(io.IOUtils.toByteArray(io.input.BoundedInputStream(stream, size)))
            stream.seek(max(0, fs.getFileStatus(at).getLen() - 1))
            return head, bytes([stream.read() & 255])
        finally:
            stream.close()


def _row(path: str, subpath: str | None, shown: str, kind: FileType, size: int, mtime: float, status: str, error: str | None = None) -> dict:
    return {
        "path_id": -1, "path": path, "subpath": subpath, "shown": shown, "file_type": kind.kind, "archive": kind.archive, "encoding": kind.encoding,
        "size": size, "mtime": mtime, "status": status, "error": error, "patterns": None, "newline": True,
    }


def _status(kind: FileType, size: int, inside: bool = False) -> tuple[str, str | None]:
    if size == 0:
        return "empty", None
    if size <= TOO_SMALL:
        return "too_small", None
    if kind.kind == "unparsable":
        return "unparsable", None
    if kind.kind in UNSUPPORTED:
        return "unsupported", f"{kind.kind} files are not parsed"
    if inside and (kind.kind == "tar" or kind.archive != "normal"):
        return "unsupported", "archives inside archives are not parsed"
    return "ok", None


def list_files(spark: SparkSession, paths: list[str], mtimes: dict[str, float] | None = None, profile: str = "clean") -> list[dict]:
    """A row for every file below ``paths`` and every entry of their tar files, in path order per argument.

    Names, sizes and the first ``HEAD_BYTES`` bytes come to the driver, as in any file listing (fewer bytes of each
    where files are many, so that all heads together stay below ``ALL_HEADS``). A path that can't be
    listed and a file that can't or needn't be read have a row with a status other than ``ok`` and the reason; they never end the
    search. ``mtimes`` (seconds by path as given or shown) replaces modification times that a copy did not keep.
    """
    tree, rows, seen = Tree(spark), [], set()
    for given in paths:
        try:
            direct, below = tree.below(given)
        except Exception as e:  # any file system's own exception: the row says what it was
            rows.append(_row(given, None, given, FileType("unparsable"), 0, 0.0, "not_found", _reason(e)))
            continue
        for path, size, mtime in below:
            if path in seen:
                continue
            seen.add(path)
            shown = given if direct else re.sub(r"^file:/+", "/", path)
            kind = file_type(path.rsplit("/", 1)[-1], direct)
            rows.append(_row(path, None, shown, kind, size, float((mtimes or {}).get(shown, mtime)), *_status(kind, size)))
    rows = _with_entries(spark, rows)
    head_bytes = max(1 << 12, min(HEAD_BYTES, ALL_HEADS // max(1, len(rows))))
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda f: _look(tree, f, head_bytes, profile), [f for f in rows if f["status"] == "ok" and f["subpath"] is None]))
    for f in rows:
        if f["subpath"] is not None and f["status"] == "ok":
            _judge(f, f.pop("head"), profile)
        f.pop("head", None)
    for i, f in enumerate(rows):
        f["path_id"] = i
    return rows


def _reason(e: Exception) -> str:
    java = getattr(e, "java_exception", None)
    return str(java.toString() if java is not None else e).splitlines()[0]


def _look(tree: Tree, f: dict, size: int, profile: str) -> None:
    """Sets what a file's first bytes tell: header time, encoding, patterns, or why it isn't read."""
    try:
        head, last = tree.ends(f["path"], size)
        if f["archive"] == "gz" and len(head) >= 8 and (at := int.from_bytes(head[4:8], "little")):
            f["mtime"] = float(at)
        head = partly_unpacked(head, f["archive"])
    except Exception as e:  # permissions, a file that vanished, a broken header: the file's own status
        f["status"], f["error"] = "unreadable", _reason(e)
        return
    f["newline"] = last == b"\n" or f["archive"] != "normal"
    _judge(f, head, profile)


def _judge(f: dict, head: bytes, profile: str) -> None:
    if f["file_type"] != "text":
        return
    if not head.strip(b"\0"):
        f["status"] = "null_bytes"
    elif not head[:128].strip(b"\xff"):
        f["status"] = "ff_bytes"
    else:
        encoding, mark = (f["encoding"].lower().replace("utf-16le", "utf-16-le"), 0) if f["encoding"] else encoding_of(head[:8192])
        f["encoding"] = encoding
        f["patterns"], f["status"] = head_profile(head[mark:], encoding, f["size"] > len(head) or f["archive"] != "normal", profile)


def _with_entries(spark: SparkSession, rows: list[dict]) -> list[dict]:
    """Tar files replaced by their entries; the entries are listed on the executors."""
    tars = [f for f in rows if f["file_type"] == "tar" and f["status"] == "ok"]
    if not tars:
        return rows
    how = {f["path"]: f["archive"] for f in tars}

    def entries(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                found = []
                try:
                    for n, entry in enumerate(tar_entries(bytes(content), how[path])):
                        found.append((path, n, entry[0], len(entry[1]), entry[2], entry[1][:HEAD_BYTES], None))
                except (OSError, EOFError, ValueError, lzma.LZMAError, zlib.error, tarfile.TarError) as e:
                    found.append((path, len(found), None, 0, 0.0, None, str(e)))
                yield pd.DataFrame(found, columns=["path", "no", "name", "size", "mtime", "head", "error"])

    schema = "path string, no long, name string, size long, mtime double, head binary, error string"
    whole = spark.read.format("binaryFile").load([f["path"] for f in tars]).select("path", "content")
    listed: dict[str, list] = {}
    for r in whole.mapInPandas(entries, schema).orderBy("path", "no").toLocalIterator():
        listed.setdefault(re.sub("^file:/+", "file:/", r["path"]), []).append(r)
    out = []
    for f in rows:
        if f not in tars:
            out.append(f)
            continue
        for r in listed.get(re.sub("^file:/+", "file:/", f["path"]), []):
            if r["name"] is None:
                out.append(f | {"status": "corrupt", "error": r["error"]})
                continue
            kind = file_type(r["name"].rsplit("/", 1)[-1], True)
            made = _row(f["path"], r["name"], f"{f['shown']}|{r['name']}", kind, r["size"], r["mtime"] or f["mtime"], *_status(kind, r["size"], True))
            out.append(made | {"archive": f["archive"], "head": bytes(r["head"] or b"")})
    return out


FILES_SCHEMA = (
    "path_id int, path string, subpath string, shown string, file_type string, archive string, encoding string, size long, mtime double, "
    "status string, error string, patterns array<int>, newline boolean"
)


def files_frame(spark: SparkSession, files: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(f.values()) for f in files], FILES_SCHEMA)
