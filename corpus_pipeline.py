"""From raw documents to packed training windows: five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quirework.llm import decontam, linededup, neardup, quality, windows
from quirework.llm.storage import ensure_checkpoint_dir


# Defined cases of all stages: other columns pass unchanged (``n_chars`` follows a changed text), an empty table
# gives an empty one, repeated rows are treated alike, and whole texts are used however long they are.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the models are trained on labelled rows of ``docs``.

    Null and empty texts have no score and stay; a null doc_id meets no label and is scored as any other.
    """
    return quality.quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents that have no text left.

    Null and empty texts pass unchanged; a null doc_id comes before all others; rows of one doc_id and
    text are one document.
    """
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: its lowest doc_id.

    Rows without words or doc_id stay; of clashing doc_ids each text is judged on its own.
    """
    return neardup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut from the texts.

    Null texts stay null and empty ones empty; a text that is all passage becomes empty; doc_ids aren't read.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of token ids.

    Null and empty texts have no ids and are in no window; a null doc_id is carried as null.
    """
    return windows.pack_windows(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]
#: No SQL: classifiers, SimHash and tokenising can't be expressed; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.mode("overwrite").parquet(path := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(path)
    return docs
