"""The corpus pipeline: quality rules, near-duplicates, decontamination, source mix, token output.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written and read again as the next one's ``docs``.
All but the last return the columns of ``documents``. Stages work on all rows their predecessor kept, so each counts its own
statistics. Rows with a null ``doc_id`` pass the quality rules, the near-duplicates and the decontamination by their text alone or untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliofield.functions.packaging import ship
from heliofield.llm import decontam, mixing, near_dedup, quality, token_output
from heliofield.llm.runtime import save, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the cascade keeps."""
    ship(spark)
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return near_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a source's cut document keeps its first words."""
    return mixing.mixed_documents(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-stride token sequences in training order."""
    ship(spark)
    return token_output.training_order(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
    ("token output", token_shards),
]

#: Near-duplicate sampling and tokenisation have no SQL form; tests/llm holds the brute-force comparison.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, name.replace(" ", "-"))
    return docs
