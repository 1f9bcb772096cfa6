"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and
reads again as the next stage's input. All but the last return the columns of ``documents``, extra ones included. Nulls,
empty and long texts, repeated rows and empty tables have the results that the operators' docstrings define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import exact_dedup, jaccard, mixing, packing, toxicity
from pairloom.llm.common import mark, release, scratch_path, store, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at or above the threshold go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal shingle sets, the one with the smallest doc_id stays."""
    return jaccard.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document occurs as often as the mix takes it."""
    return mixing.repeat(docs, mixing.WEIGHTS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a document that the mix repeats is packed as often."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Training, near-duplicate components and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage made on its way, and the table it read, go once its own table is written."""
    docs, begun = table(spark, sf_dir, "documents"), mark(spark)
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        docs = store(stage(spark, docs, sf_dir), path)
        release(spark, begun, (path,))
    return STAGES[-1][1](spark, docs, sf_dir)
