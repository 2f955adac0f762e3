"""From raw documents to training shards: five stages, each over all rows that the one before kept.

toxicity -> near-duplicate removal -> benchmark decontamination -> mixing of sources -> sharding. Each function takes
(spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet into the shared folder and reads them
again, so a lost executor never goes back further than one stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from girthline.llm import containment, mixing, neardup, sharding, toxicity

#: Similarity from which documents are near duplicates, and share of an item's shingles from which it leaked, in percent.
SIMILARITY, CONTAINED, SHARDS = 80, 80, 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic grades together are likelier than not go; the model is fitted on the labelled ones among them."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return neardup.deduplicate(docs, SIMILARITY)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return containment.decontaminate(docs, _table(spark, sf_dir, "benchmark"), CONTAINED)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out by Poisson draws towards smoothed source shares, in random order."""
    return mixing.mixed(docs).select(*docs.columns)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot."""
    return sharding.sharded(docs, SHARDS)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The fitted classifier has no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = mixing.written(stage(spark, docs, sf_dir))
    return docs
