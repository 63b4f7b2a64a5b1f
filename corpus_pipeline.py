"""A corpus from raw documents to token windows, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last keep the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import classifier, minhash, packing, quality, suffixes
from tidemark.sources.shared import remove, small_batches, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """``stage``, of which what it runs itself hands texts to Python a few MB at a time."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with small_batches(spark):
            return stage(spark, docs, sf_dir)

    return run


@bounded
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose tokenizer measures are out of their language's bands.

    Null, empty and tokenless texts go, rows with null keys are judged like others,
    repeated rows stay or go together, an empty table stays empty.
    """
    return quality.keep_good(docs)


@bounded
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score below the threshold learned from ``labels``.

    The model is fitted on at most 8000 labelled documents of what the stage before
    kept; the threshold comes from all of it. Without labels of both classes, all
    documents with words stay. Null and wordless texts go; null keys count as unlabelled.
    Its result is written here, as Python reads the texts of all rows for it.
    """
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return written(classifier.keep_preferred(docs, model), "preferred")[0]


@bounded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least key.

    Rows with null keys or null or wordless texts all stay; of rows that share a key one
    stays; an empty table stays empty.
    """
    return minhash.drop_copies(docs)


@bounded
def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of 50 words or more that occur before; emptied documents go.

    Texts are cut, so what an earlier document holds stays there. Rows with null keys or
    null texts stay as they are; rows equal in key and text are cut alike; an empty table
    stays empty.
    """
    return suffixes.drop_repeats(docs)


@bounded
def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-equal windows of at most 2048 words over all that is left.

    Texts without words have no rows, null keys stay null, repeated rows are packed
    once each, an empty table gives no windows.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near dedup", near_dedup),
    ("passage dedup", passage_dedup),
    ("packing", windows),
]

#: Tokenizer measures and learned scores have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written in the shared folder.

    A stage's result is removed once the next one's is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
