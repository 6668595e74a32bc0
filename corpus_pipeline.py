"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's documents.

toxicity (documents judged toxic go) - near duplicates by n-gram Jaccard (one document of each group
stays) - benchmark decontamination (documents holding a benchmark window go) - mixing sources to
target weights (documents are repeated or left out by rate) - sharding (the place of every document
in the compacted store). All but the last return the columns of ``documents``.

Null and empty texts are neither toxic, nor near duplicates, nor contaminated, and are mixed at their source's rate; a null id, source
or language is a value like others. Of repeated rows with words one stays, as they are copies. Ties are settled by the least id,
then by the text's hash. A source without any words isn't taken.
Very long texts pass whole. Columns beside those of ``documents``, whatever their names, are carried. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from backline.llm import decontam, mixing, neardup, sharding, toxicity
from backline.llm.common import materialise


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under the threshold."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts."""
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and shard of every row of the compacted store."""
    return sharding.shard_documents(docs)[1]


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mix_sources", mixing_stage),
    ("sharding", sharding_stage),
]

#: No SQL: the toxicity model and the forest aren't expressible. tests/llm/test_pipeline.py holds run() against brute force on planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
