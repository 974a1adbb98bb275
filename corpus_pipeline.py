"""The corpus pipeline: five stages over ``documents``, each one of the operators in ``quarry.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet to the cluster's shared folder and read again for the next
stage. All stages but the last return the columns of ``documents`` as they are.

In all of them null text counts as empty, whole texts of any length are read, rows
that repeat an id are documents of their own, an empty table gives an empty one,
and ``docs`` may have more columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import exact_dedup, ngram_join, packing, quality, toxicity
from quarry.llm.common import delete_scratch, scratch, temporary_scratch
from quarry.llm.queries import WORDS, table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity is likelier than not to be grade 1 or more go.

    Empty texts stay unless the labels call texts without words toxic; repeated
    rows go or stay together; without labels all rows stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), from_files=True)
    return toxicity.drop_toxic(docs, model)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the acceptance score go.

    Repeated rows go or stay together. Without labels of both classes there is no
    evidence about texts: each has the share of label 1 (one half without any
    labels), and all go if that is below the acceptance score.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.drop_poor(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null and empty ones are equal) the row with the largest doc_id stays, a null one only if alone; of rows that repeat that id, one."""
    return exact_dedup.drop_copies(docs, from_files=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similar ones connect, the one with the least doc_id (null first) stays; texts without words are similar to each other."""
    return ngram_join.drop_similar(docs, from_files=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of training sequences; an empty text is its end id alone."""
    return packing.pack_documents(docs, tokenizer_path(WORDS))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("packing", pack),
]

#: Scores of fitted models and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; the pieces of the last.

    What a stage wrote is deleted when the next one's output is complete.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        with temporary_scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            delete_scratch(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
