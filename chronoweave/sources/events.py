"""Event files that are read whole: Windows event logs and Apple System Log databases, packed or not."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from chronoweave.sources import asl, evtx
from chronoweave.sources.journal import highest
from chronoweave.sources.text import BROKEN, by_path, contents, whole_files

EVENTS = "path_id int, seq long, epoch_ns long, dt_beg int, dt_end int, merge_key long, raw binary"
_READ = {"evtx": evtx.records, "asl": asl.records}


def read_events(spark: SparkSession, files: list[dict]) -> DataFrame:
    """``EVENTS`` of all files; seq from 1 (event logs by datetime, databases in file order).

    Like the readers of text, a file that isn't what its name says gives no rows.
    """
    how = by_path(files)
    columns = [c.split()[0] for c in EVENTS.split(", ")]

    def read(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                for f, data, _ in contents(how, path, bytes(content)):
                    found = []
                    try:
                        for event in _READ[f["file_type"]](data or b""):
                            found.append(event)
                    except (*BROKEN, struct.error):
                        pass
                    keys = highest([e[0] for e in found])
                    rows = [(f["path_id"], i, at, b, e, int(k), raw) for i, ((at, b, e, raw), k) in enumerate(zip(found, keys), 1)]
                    for start in range(0, len(rows), 4096):
                        yield pd.DataFrame(rows[start : start + 4096], columns=columns)

    return whole_files(spark, files).mapInPandas(read, EVENTS)
