"""What the subpackage's operators take from the library: saved tables and input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliofield.functions.packaging import ship
from heliofield.functions.storage import save, shared_dir

__all__ = ["save", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; also makes sure that executors have this package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
