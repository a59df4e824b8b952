"""Shadow matrices in long form: ``alt int, az int, shadow double``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliofield.functions import clip, no_nan


def to_wide(matrix: DataFrame, azimuths: range = range(361)) -> DataFrame:
    """``Altitude_i`` rows and ``Azimuth_j`` columns; absent cells are null."""
    wide = matrix.groupBy("alt").pivot("az", list(azimuths)).agg(F.avg("shadow"))
    return wide.select(F.concat(F.lit("Altitude_"), F.col("alt")).alias("label"), *(F.col(f"`{a}`").alias(f"Azimuth_{a}") for a in azimuths))


def from_wide(wide: DataFrame) -> DataFrame:
    """Labels are read from ``Altitude_i`` and ``Azimuth_j``; null and NaN cells are 0."""
    label, *cells = wide.columns
    long = wide.unpivot([label], cells, "column", "shadow")
    return long.select(F.split_part(F.col(label), F.lit("_"), F.lit(2)).cast("int").alias("alt"), F.split_part("column", F.lit("_"), F.lit(2)).cast("int").alias("az"), no_nan(F.col("shadow").cast("double")).alias("shadow"))


def completed(matrix: DataFrame, n_alt: int = 91, n_az: int = 361) -> DataFrame:
    """All cells of the grid; absent ones are null."""
    spark = matrix.sparkSession
    cells = spark.range(n_alt).select(F.col("id").cast("int").alias("alt")).crossJoin(F.broadcast(spark.range(n_az).select(F.col("id").cast("int").alias("az"))))  # a fixed grid
    return cells.join(matrix, ["alt", "az"], "left")


def _moving(matrix: DataFrame, along: str, other: str, n: int) -> DataFrame:
    """Mean of n cells along one axis; cells beyond an edge repeat the edge. An even n reaches one cell further back."""
    low, high = -(n // 2), n - 1 - n // 2
    w = Window.partitionBy(other).orderBy(along)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last, top = F.first("shadow").over(whole), F.last("shadow").over(whole), F.max(along).over(whole)
    bottom = F.min(along).over(whole)
    before = F.greatest(F.lit(0), bottom - (F.col(along) + low))
    after = F.greatest(F.lit(0), F.col(along) + high - top)
    return matrix.withColumn("shadow", (F.sum("shadow").over(w.rowsBetween(low, high)) + before * first + after * last) / n)


def smooth(matrix: DataFrame, size_az: int = 2, size_alt: int = 2) -> DataFrame:
    """Separable moving average with clamped edges (azimuth does not wrap), clipped to 0..1."""
    filled = matrix.withColumn("shadow", no_nan(F.col("shadow")))
    return _moving(_moving(filled, "alt", "az", size_alt), "az", "alt", size_az).withColumn("shadow", clip(F.col("shadow"), 0.0, 1.0))


def hemisphere_factor(matrix: DataFrame, label_aligned: bool = False) -> DataFrame:
    """One row: mean shadow weighted by cos z sin z. Rows count as altitudes 1, 2, ... unless ``label_aligned``."""
    z = F.radians(90.0 - (F.col("alt") + (0 if label_aligned else 1)))
    w = F.cos(z) * F.sin(z)
    return matrix.agg(F.sum(F.col("shadow") * w).alias("s"), F.sum(w).alias("w")).select(F.when(F.col("w") != 0, F.col("s") / F.col("w")).otherwise(0.0).alias("factor"))


def cell_of(altitude: Column, azimuth: Column, n_alt: int = 91, n_az: int = 361, legacy: bool = False) -> tuple[Column, Column]:
    """Row and column of a sun position: half-to-even rounding, clipped. ``legacy``: the row is altitude - 1, from altitude 1 up."""
    row = F.rint(F.greatest(altitude, F.lit(1.0)) - 1) if legacy else F.rint(altitude)
    return clip(row, 0, n_alt - 1).cast("int"), clip(F.rint(azimuth), 0, n_az - 1).cast("int")


def lookup(positions: DataFrame, matrix: DataFrame, name: str = "beam_shadow", legacy: bool = False) -> DataFrame:
    """Beam shadow at (altitude, azimuth): 0 unless the sun is above half a degree. A matrix is a fixed 91 x 361 grid."""
    row, col = cell_of(F.col("altitude"), F.col("azimuth"), legacy=legacy)
    cells = F.broadcast(matrix.select(F.col("alt").alias("__r"), F.col("az").alias("__c"), "shadow"))
    found = positions.withColumn("__r", row).withColumn("__c", col).join(cells, ["__r", "__c"], "left")
    return found.withColumn(name, F.when(F.col("altitude") > 0.5, clip(F.coalesce("shadow", F.lit(0.0)), 0.0, 1.0)).otherwise(0.0)).drop("__r", "__c", "shadow")


def stats(matrix: DataFrame) -> DataFrame:
    return matrix.agg(F.min("shadow").alias("low"), F.max("shadow").alias("high"), F.avg("shadow").alias("mean"))


def azimuth_sweep(matrix: DataFrame, altitude: int) -> DataFrame:
    return matrix.where(F.col("alt") == altitude).select("az", "shadow")
