"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; a temporary folder only where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.chronoweave.scratch", None) or "file://" + tempfile.mkdtemp(prefix="chronoweave-")
        spark.conf.set("spark.chronoweave.scratch", base)
    return f"{base.rstrip('/')}/chronoweave-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, so that later steps don't repeat its scans."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
