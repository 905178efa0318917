"""A cleaning pipeline over `documents`: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage's result as
Parquet in the shared scratch folder and reads it again as the next one's input. All stages but the last return the columns of
`documents`; the last adds `shard` and `slot`. Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import external_shuffle, near_dup, robust_outliers, source_mix, wu_manber
from quillgraph.plans.scratch import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie too far from their group's robust estimate go."""
    return robust_outliers.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the least id stays."""
    return near_dup.keep_one(docs, shingle=5, threshold_pct=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    return wu_manber.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the sources' targets take it."""
    return source_mix.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in random order over eight shards of equal numbers of rows."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return external_shuffle.shuffle(docs, key=F.xxhash64("doc_id", "text", "lang", "source", "n_chars"), size=size)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("source mixing", mix_sources),
    ("sharding", shard),
]

#: Robust estimates, MinHash samples and seeded permutations are not expressible in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
