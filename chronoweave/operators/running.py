"""Running sums, maxima and next values over long ordered groups, in two steps.

A group (a file) may hold most of all rows. A plain window would put it into one task; here rows
are windowed inside blocks of bounded size, blocks are reduced to one row each, those few rows are
windowed, and their results are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_running(df: DataFrame, group: list[str], block: str, pos: str, made: dict[str, tuple[str, Column]], backwards: bool = False) -> DataFrame:
    """Adds columns name -> (``sum`` or ``max``, value), running over (block, pos), the row itself included."""
    turn = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    fold = {"sum": F.sum, "max": F.max}
    inside = Window.partitionBy(*group, block).orderBy(turn(pos)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy(turn(block)).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, block).agg(*[fold[f](v).alias(f"_{n}") for n, (f, v) in made.items()])
    totals = totals.select(*group, block, *[fold[f](f"_{n}").over(earlier).alias(f"_{n}") for n, (f, _) in made.items()])
    local = df.select("*", *[fold[f](v).over(inside).alias(n) for n, (f, v) in made.items()])
    joined = local.join(_renamed(totals, group, block), [local[c].eqNullSafe(F.col(f"_k_{c}")) for c in [*group, block]], "left")
    both = {n: F.coalesce(F.col(f"_{n}"), F.lit(0)) + F.col(n) if f == "sum" else F.greatest(F.col(f"_{n}"), F.col(n)) for n, (f, _) in made.items()}
    return joined.select(*df.columns, *[both[n].alias(n) for n in made])


def with_next(df: DataFrame, group: list[str], block: str, pos: str, name: str, value: Column) -> DataFrame:
    """Adds the value of the row after each in (block, pos) order; null for a group's last row."""
    inside = Window.partitionBy(*group, block).orderBy(pos)
    later = Window.partitionBy(*group).orderBy(block)
    firsts = df.groupBy(*group, block).agg(F.min_by(value, F.col(pos)).alias("_first"))
    firsts = firsts.select(*group, block, F.lead("_first").over(later).alias("_next"))
    local = df.select("*", F.lead(value).over(inside).alias(name))
    joined = local.join(_renamed(firsts, group, block), [local[c].eqNullSafe(F.col(f"_k_{c}")) for c in [*group, block]], "left")
    return joined.select(*df.columns, F.coalesce(F.col(name), F.col("_next")).alias(name))


def _renamed(df: DataFrame, group: list[str], block: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_k_{c}") if c in (*group, block) else F.col(c) for c in df.columns])
