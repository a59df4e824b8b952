"""Audits that trace one day or one sight line through the stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliofield.operators.forensics import landmarks
from heliofield.operators.matrix import cell_of, lookup
from heliofield.operators.series import nearest_in_time


def chain_audit(stages: dict[str, tuple[DataFrame, str]], ts: str = "t") -> DataFrame:
    """stage, day and the landmark times of each stage's series (a frame and its value column)."""
    parts = [landmarks(df, value, ts).select(F.lit(name).alias("stage"), "*") for name, (df, value) in stages.items()]
    return reduce(DataFrame.unionByName, parts)


def shadow_audit(positions: DataFrame, probes: DataFrame, raw: DataFrame, smoothed: DataFrame, ts: str = "t", within_minutes: int = 240) -> DataFrame:
    """At each probe time: the nearest sun position, its matrix cell, and the raw and smoothed shadow there."""
    at = nearest_in_time(positions, probes, ts, ["altitude", "azimuth"], within_minutes).where("nearest is not null")
    row, col = cell_of(F.col("altitude"), F.col("azimuth"))
    out = at.withColumn("row", row).withColumn("col", col)
    return lookup(lookup(out, raw, "raw_shadow"), smoothed, "smoothed_shadow")


def altitude_profile(matrix: DataFrame, azimuth: int) -> DataFrame:
    """Shadow by altitude at one azimuth."""
    return matrix.where(F.col("az") == azimuth).select("alt", "shadow")


def facade_shadows(positions: DataFrame, matrix: DataFrame, facade_azimuth: float, width: float = 30.0, least: float = 0.3) -> DataFrame:
    """Positions near a facade's azimuth with a beam shadow above ``least``."""
    near = F.abs(F.pmod(F.col("azimuth") - facade_azimuth + 180.0, F.lit(360.0)) - 180.0) <= width
    return lookup(positions.where(near & (F.col("altitude") > 0.5)), matrix, "beam_shadow").where(F.col("beam_shadow") > least)


def scene_rays(panels: DataFrame, positions: DataFrame, matrix: DataFrame, length: float = 50.0) -> DataFrame:
    """Ray end points of every panel towards each sun position, with the transmittance shown there (1 below the horizon)."""
    e, a = F.radians("altitude"), F.radians("azimuth")
    sun = lookup(positions, matrix, "beam_shadow").withColumn("transmittance", F.when(F.col("altitude") > 0.5, 1 - F.col("beam_shadow")).otherwise(1.0))
    sun = sun.withColumn("ux", F.cos(e) * F.sin(a)).withColumn("uy", F.cos(e) * F.cos(a)).withColumn("uz", F.sin(e))
    met = sun.crossJoin(F.broadcast(panels.select("panel", "x", "y", "z")))  # a specification of a few rows
    return met.select(*positions.columns, "panel", "transmittance", *((F.col(c) + length * F.col(f"u{c}")).alias(f"end_{c}") for c in "xyz"))
