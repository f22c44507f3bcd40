"""The corpus pipeline: quality classifier, exact dedup, near dedup, decontamination, packing.

Each stage reads all that the one before it kept, from Parquet in the session's shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from chronoweave.llm.runtime import materialise, small, table


def _keep(docs: DataFrame, verdict: DataFrame, of: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` that ``verdict`` keeps, with all their columns; rows equal in id and text become one.

    ``verdict`` has a row for each of ``docs``, with doc_id, kept and the columns of ``of``, which says how they come from a
    document. They decide where several rows share a doc_id (or have none); elsewhere the doc_id does.
    """
    named = {c: f"_verdict_{c}" for c in ("doc_id", "kept", *of)}
    verdict = materialise(verdict.select(*[F.col(c).alias(n) for c, n in named.items()]))
    same_id = F.col("doc_id").eqNullSafe(F.col(named["doc_id"]))
    ids = verdict.groupBy(named["doc_id"]).agg(F.max(named["kept"]).alias("_verdict_kept"), F.count("*").alias("_verdict_n"))
    ids = materialise(ids.where("not _verdict_kept or _verdict_n > 1"))
    rest = docs.join(small(ids.select(named["doc_id"])), same_id, "left_anti")
    shared = ids.where("_verdict_kept").select(named["doc_id"])
    if shared.limit(1).count() == 0:
        return rest
    again = docs.join(small(shared), same_id, "left_semi")
    same_row = same_id
    for c, value in of.items():
        same_row = same_row & value.eqNullSafe(F.col(named[c]))
    return rest.unionByName(again.join(verdict.where("_verdict_kept"), same_row, "left_semi").dropDuplicates(["doc_id", "text"]))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at its threshold or above.

    Null and empty texts have the bias as their score. Repeated rows and null ids are judged like others, and extra columns stay;
    an empty table stays empty.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (blanks aside); null and empty texts are one group.

    Of rows that repeat wholly one stays, also under a null or shared doc_id. Extra columns stay; an empty table stays empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    of = {"text_sha256": F.sha2(F.translate(text, exact_dedup.BLANKS, ""), 256), "n_chars": F.char_length(text).cast("long")}
    return _keep(docs, exact_dedup.exact_dedup(docs), of)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; documents without words or id stay.

    Extra columns stay; an empty table stays empty.
    """
    return _keep(docs, near_dedup.near_dedup(docs, words=5, num=80, den=100), {})


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item; null and empty texts hold none, an empty benchmark removes none."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their bins: a document beyond a bin's size has several pieces; an empty table gives none."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("best_fit_packing", packing_stage),
]
#: The classifier and the alignments aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
