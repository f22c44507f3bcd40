"""Text files to lines, the lines of a block together and in file order.

Plain UTF-8 files go through Spark's own text scan, so large ones are split; a block is a split, named by its
offset. Packed files, UTF-16, UTF-32 and tar entries are read whole, one file a task, and decoded there; their blocks
are runs of lines. A file or entry that can't be decoded gives no lines; ``errors.read_errors`` says why.
"""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.sources.bytes import split_lines, tar_entries, unpacked

#: Lines of one block of a decoded file, and lines handed on at once.
BLOCK_LINES, PART_LINES = 1 << 20, 1 << 16
#: As many parts as a scan is cut into, if its files are large enough; the cores at that time, where it is not set.
MIN_PARTITIONS = "spark.sql.files.minPartitionNum"
#: What a broken packed or tar file raises.
BROKEN = (OSError, EOFError, ValueError, IndexError, lzma.LZMAError, zlib.error)
LINES = "path_id int, block long, raw binary"


def _steady(spark: SparkSession) -> SparkSession:
    """A session with the settings that ``spark`` has now, whose scans are cut for the cores that there are now.

    Where files are split depends on settings and cores at the time a scan starts. Several passes that name blocks by
    their splits must cut alike, though executors come and go, or settings change, between them.
    """
    held = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if held.conf.get(key, None) != value:
            held.conf.set(key, value)
    if held.conf.get(MIN_PARTITIONS, None) is None:
        held.conf.set(MIN_PARTITIONS, str(spark.sparkContext.defaultParallelism))
    return held


def _scan(spark: SparkSession, files: list[dict], known: DataFrame) -> DataFrame:
    """Lines by the text scan. Bytes pass unchanged; every line gets back its newline, but for a last line without one."""
    lines = _steady(spark).read.text([f["path"] for f in files], lineSep="\n").select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_block_start").alias("block"),
        (F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length")).alias("_end"), F.col("value").cast("binary").alias("_line"),
    )
    raw = F.concat("_line", F.lit(b"\n")).alias("raw")
    open_end = (~F.col("newline") & (F.col("_end") >= F.col("_size"))).alias("open_end")
    # the session of the left side runs the query; the scan's own only cuts its files
    return F.broadcast(known.withColumnRenamed("path", "_known")).join(lines, F.col("_path") == F.col("_known")).select(*[c for c in known.columns if c not in ("path", "newline")], "block", open_end, raw)


def contents(path_of: dict[str, list[dict]], path: str, content: bytes, single_member: bool = False) -> Iterator[tuple[dict, bytes | None, str | None]]:
    """(file, bytes, error) of each listed file or entry that ``content`` holds."""
    wanted = path_of[path]
    try:
        if wanted[0]["subpath"] is None:
            yield wanted[0], unpacked(content, wanted[0]["archive"], single_member), None
        else:
            by_name = {f["subpath"]: f for f in wanted}
            for name, data, _ in tar_entries(content, wanted[0]["archive"]):
                if name in by_name:
                    yield by_name[name], data, None
    except BROKEN as e:
        yield wanted[0], None, f"{type(e).__name__}: {e}"


def by_path(files: list[dict]) -> dict[str, list[dict]]:
    """Files by path, in both spellings that Spark uses for local ones."""
    found: dict[str, list[dict]] = {}
    slim = ("path_id", "path", "subpath", "archive", "encoding", "file_type")
    for f in files:
        for name in {f["path"], f["path"].replace("file:///", "file:/"), f["path"].replace("file:/", "file:///") if not f["path"].startswith("file:///") else f["path"]}:
            found.setdefault(name, []).append({k: f[k] for k in slim})
    return found


def whole_files(spark: SparkSession, files: list[dict]) -> DataFrame:
    return spark.read.format("binaryFile").load(sorted({f["path"] for f in files})).select("path", "content")


def _decoded(spark: SparkSession, files: list[dict], single_member: bool) -> DataFrame:
    how = by_path(files)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                for f, data, _ in contents(how, path, bytes(content), single_member):
                    lines = split_lines(data, f["encoding"]) if data is not None else []
                    for start in range(0, len(lines), PART_LINES):
                        some = lines[start : start + PART_LINES]
                        yield pd.DataFrame({"path_id": f["path_id"], "block": start // BLOCK_LINES, "raw": some})

    return whole_files(spark, files).mapInPandas(read, LINES)


def read_lines(spark: SparkSession, files: list[dict], known: DataFrame, single_member: bool = False) -> DataFrame:
    """block, open_end (the file's last line has no newline, its block is the last), raw and ``known``'s columns for every line of the text files."""
    scan = [f for f in files if f["archive"] == "normal" and f["subpath"] is None and f["encoding"] == "utf-8"]
    scanned = {f["path_id"] for f in scan}
    rest = [f for f in files if f["path_id"] not in scanned]
    frames = [_scan(spark, scan, known)] if scan else []
    if rest:
        about = known.drop("path", "newline").withColumnRenamed("path_id", "_id")
        lines = _decoded(spark, rest, single_member).join(F.broadcast(about), F.col("path_id") == F.col("_id"))
        frames.append(lines.select(*[c for c in known.columns if c not in ("path", "newline")], "block", F.lit(False).alias("open_end"), "raw"))
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])

