"""Session helpers shared by the operators: tables, shared scratch space, bounds.

Everything that one job leaves for a later one goes below ``spark.checkpoint.dir``, which the
driver and all executors share, so an executor that dies takes nothing with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.plans.shared import shared_path

#: Sides with at most this many rows of a few numbers each may be broadcast (about 16 MB).
BROADCAST_ROWS = 500_000
#: The same for sides of one to three 64-bit numbers: at most 48 MB, about 150 MB as a hash table.
BROADCAST_NUMBERS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path below the session's shared checkpoint folder."""
    return shared_path(spark)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes the files of materialised tables that nothing reads any more; other tables are left alone."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted size is within the bound, else unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

