"""Sun position as column expressions (low-precision solar theory of Meeus as published by NOAA, Bennett's refraction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliofield.functions import once

SITE = (62.979849, 27.648656)


def refraction(elevation: Column) -> Column:
    """Degrees to add near and above the horizon at standard pressure and 12 C."""
    near = (1013.25 / 1010.0) * (283.0 / 285.0) * 1.02 / (60 * F.tan(F.radians(elevation + 10.3 / (elevation + 5.11))))
    return F.when(elevation >= -0.83337, near).otherwise(0.0)


def sun_position(times: DataFrame, ts: str = "ts", lat: float = SITE[0], lon: float = SITE[1]) -> DataFrame:
    """Adds elevation, azimuth and altitude (with refraction); ``ts`` is UTC without a zone. Constants are the published theory's fixed values.

    Each step's terms are columns of their own, so none is copied into the next step's many uses of it."""
    sin, cos = (lambda x: F.sin(F.radians(x))), (lambda x: F.cos(F.radians(x)))
    s, t, l0, m, ecc, node = (F.col(f"__{k}") for k in ("s", "t", "l0", "m", "ecc", "node"))
    out = times.withColumn("__s", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).withColumn("__t", (s / 86400.0 + 2440587.5 - 2451545.0) / 36525.0)
    out = out.withColumn("__l0", F.pmod(280.46646 + t * (36000.76983 + 0.0003032 * t), F.lit(360.0))).withColumn("__m", 357.52911 + t * (35999.05029 - 0.0001537 * t))
    out = once(out.withColumn("__ecc", 0.016708634 - t * (0.000042037 + 0.0000001267 * t)).withColumn("__node", 125.04 - 1934.136 * t))
    center = sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * m) * (0.019993 - 0.000101 * t) + sin(3 * m) * 0.000289
    out = out.withColumn("__sun", l0 + center - 0.00569 - 0.00478 * sin(node))
    out = once(out.withColumn("__tilt", 23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - 0.001813 * t))) / 60) / 60 + 0.00256 * cos(node)))
    half = F.tan(F.radians(F.col("__tilt") / 2))
    out = once(out.withColumn("__decl", F.asin(sin(F.col("__tilt")) * sin(F.col("__sun")))).withColumn("__y", half * half))
    y, decl = F.col("__y"), F.col("__decl")
    equation = 4 * F.degrees(y * sin(2 * l0) - 2 * ecc * sin(m) + 4 * ecc * y * sin(m) * cos(2 * l0) - 0.5 * y * y * sin(4 * l0) - 1.25 * ecc * ecc * sin(2 * m))
    solar = F.pmod(F.pmod(s, F.lit(86400.0)) / 60 + equation + 4 * lon, F.lit(1440.0))
    out = once(out.withColumn("__hour", F.radians(solar / 4 - 180)))
    hour, phi = F.col("__hour"), F.radians(F.lit(lat))
    up = F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(hour)
    elevation = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up))))
    azimuth = F.pmod(F.degrees(F.atan2(F.sin(hour), F.cos(hour) * F.sin(phi) - F.tan(decl) * F.cos(phi))) + 180, F.lit(360.0))
    out = once(out.select(*times.columns, elevation.alias("elevation"), azimuth.alias("azimuth")))
    return once(out.withColumn("altitude", F.col("elevation") + refraction(F.col("elevation"))))


def minute_spine(days: DataFrame, step_minutes: int = 1, day: str = "day") -> DataFrame:
    """Every step of each day, as ``ts`` beside the day's columns."""
    start = F.col(day).cast("timestamp_ntz")
    return days.withColumn("ts", F.explode(F.sequence(start, start + F.expr(f"interval '{24 * 60 - step_minutes}' minute"), F.expr(f"interval '{step_minutes}' minute"))))


def sunrise_per_day(days: DataFrame, lat: float = SITE[0], lon: float = SITE[1]) -> DataFrame:
    """day, sunrise: the first minute with the sun's centre above the horizon."""
    return sun_position(minute_spine(days), "ts", lat, lon).where("elevation > 0").groupBy("day").agg(F.min("ts").alias("sunrise"))


def sun_paths(spark, days: list[str] | DataFrame, lat: float = SITE[0], lon: float = SITE[1]) -> DataFrame:
    """Sun paths of reference days (dates, or a DataFrame with ``day``) at ten minutes, where the sun is up."""
    base = days.select("day").distinct() if isinstance(days, DataFrame) else spark.createDataFrame([(d,) for d in days], "day string").select(F.to_date("day").alias("day"))
    return sun_position(minute_spine(base, 10), "ts", lat, lon).where("elevation > 0")


def interpolate(curve: DataFrame, x: str, y: str, at: DataFrame, key: str) -> DataFrame:
    """Linear interpolation of ``at.x`` on each key's sorted samples; 0 outside their range."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(x)
    pieces = curve.select(key, F.col(x).alias("__x0"), F.col(y).alias("__y0"), F.lead(x).over(w).alias("__x1"), F.lead(y).over(w).alias("__y1")).where("__x1 is not null")
    met = at.join(pieces, key).where((F.col(x) >= F.col("__x0")) & ((F.col(x) < F.col("__x1")) | (F.col(x) == F.col("__x1"))))
    value = met.groupBy(*at.columns).agg(F.min(F.col("__y0") + (F.col(x) - F.col("__x0")) / F.nullif(F.col("__x1") - F.col("__x0"), F.lit(0.0)) * (F.col("__y1") - F.col("__y0"))).alias(y))
    return at.join(value, at.columns, "left").withColumn(y, F.coalesce(y, F.lit(0.0)))
