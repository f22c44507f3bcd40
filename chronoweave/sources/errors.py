"""What went wrong with single files, found by reading them to their end."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession

from chronoweave.sources import asl, evtx, fixed, journal
from chronoweave.sources.text import BROKEN, by_path, contents, whole_files


def _problem(f: dict, data: bytes) -> str | None:
    kind = f["file_type"]
    try:
        if kind == "evtx":
            evtx.records(data)
        elif kind == "asl":
            list(asl.records(data))
        elif kind == "journal":
            list(journal.entries(data))
        elif kind.startswith("fixed:") and fixed.layout_of(data, kind.split(":")[1]) is None:
            return "no known record layout"
    except (*BROKEN, struct.error) as e:
        return f"{type(e).__name__}: {e}"
    return None


def read_errors(spark: SparkSession, files: list[dict]) -> dict[int, str]:
    """path_id to error of the packed, archived, record and event files that can't be read to their end; plain text can't fail so."""
    doubtful = [f for f in files if f["status"] == "ok" and (f["archive"] != "normal" or f["subpath"] is not None or f["file_type"] != "text")]
    if not doubtful:
        return {}
    how = by_path(doubtful)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = []
            for path, content in zip(pdf["path"], pdf["content"]):
                for f, data, error in contents(how, path, bytes(content)):
                    error = error or _problem(f, data)
                    found += [(f["path_id"], error)] if error else []
            yield pd.DataFrame(found, columns=["path_id", "error"])

    return {r["path_id"]: r["error"] for r in whole_files(spark, doubtful).mapInPandas(read, "path_id int, error string").collect()}
