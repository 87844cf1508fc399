"""A training-data pipeline over ``documents``: toxicity, quality, near duplicates, source mix, packing.

Each stage takes (spark, docs, folder), works on all that its predecessor kept, and returns a frame; ``run`` writes it as Parquet to the shared
folder and the next stage reads it back.  All but the last return the columns of ``documents``.  SQL can't express the learned and the
iterative stages, so there is no SQL for the whole; the tests hold the result against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuskit.llm import mixing, packing, quality_rules, simhash_dedup, toxicity
from corpuskit.llm.common import table
from corpuskit.session import staged

ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.drop_toxic(docs, table(spark, folder, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that fail the base or a risk-controlled cutoff go."""
    return quality_rules.keep_good(docs, table(spark, folder, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates stays: Jaccard 0.8 or more over five-word shingles."""
    return simhash_dedup.keep_one(docs, width=5, similar=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents are emitted as often as the mix of their source takes them."""
    return mixing.emit(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Where each piece of each emitted document lies in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
