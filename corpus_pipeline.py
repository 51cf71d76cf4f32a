"""From raw documents to shards: quality rules, near duplicates, benchmark passages, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; ``run`` writes every stage as Parquet into the folder
the session shares (``spark.checkpoint.dir``) and reads it again, so a lost executor costs no more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm import decontamination, mixing, ngram_join, quality_rules, sharding
from corpuscle.llm.frames import table
from corpuscle.scratch import materialize


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass line-first cleaning, without the lines that fail."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of every group of near duplicates."""
    return ngram_join.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights; a document occurs as often as it is taken."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with the slot and shard of every row."""
    return sharding.shard(docs)


STAGES = [("quality rules", rules), ("near duplicates", near_duplicates), ("decontamination", benchmark), ("mixing", mixture), ("sharding", shards)]

# mixing draws at random, which SQL cannot repeat; tests/llm checks the rows against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
