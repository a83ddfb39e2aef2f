"""The corpus pipeline: documents in, a weighted mix out, each stage over all the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillproof.llm import decontaminate, language, mixing, near_copies, pii
from tillproof.scale import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, so without a language, go; one without ``lang`` gets its own."""
    return language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, alike in 0.8 of their five-word runs or more, stays."""
    return near_copies.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a test item or more go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars counts the new text."""
    cleaned = pii.redact(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes; ``write_corpus`` writes the mix itself."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
]

# Training, near-duplicate groups and tiles cannot be written as SQL; the tests use brute force.
ORACLE_SQL: str | None = None


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that go into the mix, as the stages before it leave them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, kept(spark, sf_dir), sf_dir)


def write_corpus(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Write the mixed text under ``folder``: corpus (shard, slot, source, block, text) and taken, the
    rows of ``run``; both from one deal. The corpus is returned."""
    deal = mixing.Deal(kept(spark, sf_dir))
    deal.counted().write.mode("errorifexists").parquet(f"{folder}/taken")
    deal.mixed().write.mode("errorifexists").parquet(f"{folder}/corpus")
    return spark.read.parquet(f"{folder}/corpus")
