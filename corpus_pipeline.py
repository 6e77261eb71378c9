"""The corpus pipeline: five stages from raw documents to a mix for training.

Every stage takes the documents that the one before it has left, written as
Parquet. All but the last return the columns of ``documents``; ``n_chars`` follows
the text. The last returns a row for each time a document is taken (``copy``
counts from 1).

A row stays unless a stage rejects it: texts of null or without words pass all
filters, and of those with equal texts one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import decontaminate, line_windows, mixing, near_dup, toxicity
from tidegrid.session import written

#: A document is rejected as toxic from this score on.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a machine trained on all labels does not find toxic.

    Equal texts share their fate, null and empty ones stay as long as most sentences
    are clean; where nothing tells toxic documents from clean ones (no labels of both
    classes among them), all stay; all columns pass.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, out_of=None)
    if not model.marks:
        return docs
    return toxicity.scored(docs, model).where(F.col("score") < TOXIC).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of three consecutive lines.

    Ties of doc_id go by text and place; null doc_ids come first; repeated rows lose
    the same lines; null texts stay null; ``n_chars`` follows the text, other columns pass.
    """
    left = line_windows.without_repeats(docs, width=3)
    return left.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of near duplicates.

    Of repeated rows one stays, of texts without words one of each spelling; a null
    doc_id counts as the highest; all columns pass.
    """
    return near_dup.representatives(docs, k=5, threshold=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item.

    Null texts, texts of fewer words and all documents beside an empty benchmark
    stay; an item of fewer words is one window; all columns pass.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, with a column ``copy`` from 1.

    Null is a source; documents without words are taken if their source is; rows of
    one doc_id draw alike; an own column ``copy`` stays, the new one is then ``_copy``.
    """
    return mixing.repeat(docs, weights=(1, 2, 3), cap=3, seed=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: Toxicity and near duplicates can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
