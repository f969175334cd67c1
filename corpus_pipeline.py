"""A training corpus from raw documents: five stages, each a corpus operator on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.llm.common import discard, saved, table
from cubespark.llm.decontaminate import remove_contamination
from cubespark.llm.near import keep_one
from cubespark.llm.packing import pack_documents
from cubespark.llm.quality import score_quality
from cubespark.llm.secrets import redact

#: Rows that go to a Python worker at a time while a stage is written: texts pile up in the executor and in its workers.
ROWS = 2000


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good, as a written table.

    Texts that are null, empty or without a word go; repeated rows fare alike; a null id plays no part; an empty table
    stays empty; other columns stay, whatever their names.
    """
    scored = score_quality(docs)
    return saved(scored.where(F.col(f"`{scored.columns[-1]}`") >= 0.5).select(*(F.col(f"`{c}`") for c in docs.columns)), "quality", ROWS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, as a written table; odd rows as keep_one says."""
    return saved(keep_one(docs), "near_duplicates", ROWS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages, as a written table: a row for each row, null texts stay null."""
    return saved(_counted(remove_contamination(docs, table(spark, sf_dir, "benchmark"))), "decontaminate", ROWS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose secrets are replaced by their kind, as a written table: a row for each row, null texts stay null."""
    return saved(_counted(redact(docs)), "secrets", ROWS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; a null or empty text is its end id alone, an empty table gives no pieces."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]
#: No stage can be told in SQL: tests hold run() against a plain version of the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
