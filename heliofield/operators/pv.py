"""Clear days, weather, shade-corrected power, metrics and summaries."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliofield.functions import clip, sigmoid
from heliofield.operators.matrix import hemisphere_factor, lookup
from heliofield.operators.series import asof_backward, full_join, resample


@dataclass(frozen=True)
class Site:
    """Site parameters and their defaults (fixed values of the studied site)."""

    latitude: float = 62.979849
    longitude: float = 27.648656
    logger_offset: int = 3
    efficiency: float = 0.95
    albedo_snow: float = 0.65
    albedo_bare: float = 0.20
    nominal_w: float = 3960.0
    tilt: float = 12.0
    azimuth: float = 170.0


def clear_days(counts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Days whose count exceeds Q3 + threshold * (Q3 - Q1); ``counts``: day, n."""
    q = counts.agg(F.percentile("n", F.lit(0.25)).alias("q1"), F.percentile("n", F.lit(0.75)).alias("q3"))
    return counts.crossJoin(F.broadcast(q)).where(F.col("n") > F.col("q3") + threshold * (F.col("q3") - F.col("q1"))).select("day", "n")  # one row


def exclude_days(days: DataFrame, listed: list[str], day: str = "day") -> DataFrame:
    return days.where(~F.col(day).isin(*[F.lit(d).cast("date") for d in listed]))


def ranked_days(days: DataFrame, k: int) -> DataFrame:
    """The k days with the highest counts, with their ranks."""
    top = days.orderBy(F.desc("n"), "day").limit(k)
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "day")))  # k rows


def albedo(temperature: Column, site: Site = Site()) -> Column:
    """From a mean temperature: a sigmoid snow share mixes the two albedos; bare ground without a temperature."""
    snow = sigmoid(-temperature, -1.0, 4.0 / 3.0)
    return F.when(temperature.isNull() | F.isnan(temperature), site.albedo_bare).otherwise(F.round(snow * site.albedo_snow + (1 - snow) * site.albedo_bare, 3))


def albedo_legacy(temperature: Column) -> Column:
    return F.when(temperature < 0, 0.7).otherwise(0.2)


def weather_day(weather: DataFrame, radiation: DataFrame, cams: DataFrame | None, ts: str = "t", site: Site = Site()) -> DataFrame:
    """Assembled weather, one row a five-minute bin: full join, bin means, and the day's albedo.

    The satellite series ``cams`` gives dni as of each bin, and ghi and dhi where the ground has none and it has such columns; without it dni is 0.
    ``weather`` may have a wind column."""
    joined = full_join([weather, radiation], ts)
    ground = [c for c in ("temp", "wind", "ghi", "dhi") if c in joined.columns]
    binned = resample(joined, ts, ground).withColumn("day", F.to_date(ts))
    for c in {"temp", "wind", "ghi", "dhi"} - set(ground):
        binned = binned.withColumn(c, F.lit(None).cast("double"))
    daily = binned.groupBy("day").agg(F.avg("temp").alias("mean_temp"))
    if cams is None:
        filled = binned.withColumn("dni", F.lit(0.0))
    else:
        filled = asof_backward(binned, cams, ts).withColumn("dni", F.col("match.dni"))
        for c in {"ghi", "dhi"} & set(cams.columns):
            filled = filled.withColumn(c, F.coalesce(c, F.col("match")[c]))
    return filled.join(daily, "day").select("day", ts, "dni", "dhi", "ghi", "temp", "wind", albedo(F.col("mean_temp"), site).alias("albedo"))


def apply_shadows(forecast: DataFrame, matrix: DataFrame, beam_only: bool = False) -> DataFrame:
    """``forecast``: altitude, azimuth, output and, unless ``beam_only``, dni, dhi, ghi. Adds shadow factors and output_shaded <= output."""
    out = lookup(forecast, matrix, "shadow_beam").crossJoin(F.broadcast(hemisphere_factor(matrix).select(clip(F.col("factor"), 0.0, 1.0).alias("shadow_diffuse"))))  # one row
    sb, sd = F.col("shadow_beam"), F.col("shadow_diffuse")
    if beam_only:
        return out.withColumn("output_shaded", F.col("output") * (1 - sb))
    ghi = F.greatest(F.col("ghi"), F.lit(1e-6))
    cosz = F.greatest(F.cos(F.radians(90.0 - F.col("altitude"))), F.lit(0.0))
    b = F.coalesce(clip(F.when(F.col("dni").isNotNull(), F.col("dni") * cosz / ghi), 0.0, 1.0), F.lit(0.0))
    b = F.when(F.col("dni").isNull() | F.col("ghi").isNull(), 0.0).otherwise(b)
    d = F.when(F.col("dhi").isNull() | F.col("ghi").isNull(), 0.0).otherwise(clip(F.col("dhi") / ghi, 0.0, 1.0))
    out = out.withColumn("beam_fraction", b).withColumn("diffuse_fraction", d)
    o = clip(1 - F.col("beam_fraction") - F.col("diffuse_fraction"), 0.0, 1.0)
    t = clip(F.col("beam_fraction") * (1 - sb) + F.col("diffuse_fraction") * (1 - sd) + o * (1 - sd), 0.0, 1.0)
    return out.withColumn("output_shaded", F.col("output") * t)


def baseline_power(weather: DataFrame, site: Site = Site()) -> DataFrame:
    """A documented stand-in for an external forecaster: isotropic transposition, linear cell temperature (NOCT 45 C), -0.4 %/K.

    ``weather``: altitude, azimuth, dni, dhi, ghi, temp, wind, albedo. It makes no claim of numeric parity with any other model."""
    tilt, aim = math.radians(site.tilt), F.radians(F.lit(site.azimuth))
    alt, az = F.radians("altitude"), F.radians("azimuth")
    incidence = F.greatest(F.sin(alt) * math.cos(tilt) + F.cos(alt) * math.sin(tilt) * F.cos(az - aim), F.lit(0.0))
    plane = F.when(F.col("altitude") > 0, F.col("dni") * incidence).otherwise(0.0) + F.col("dhi") * ((1 + math.cos(tilt)) / 2) + F.col("ghi") * F.col("albedo") * ((1 - math.cos(tilt)) / 2)
    cell = F.col("temp") + F.col("plane") * (25.0 / 800.0) * 9.5 / (5.7 + 3.8 * F.col("wind"))
    out = weather.withColumn("plane", F.greatest(plane, F.lit(0.0)))
    return out.withColumn("output", F.greatest(F.col("plane") / 1000.0 * site.nominal_w * (1 - 0.004 * (cell - 25.0)), F.lit(0.0)))


def day_metrics(pairs: DataFrame, day: str = "day", daytime: float = 10.0) -> DataFrame:
    """RMSE, MAE, MBE, R2 of base and shaded against real over daytime rows, and energies over all rows; one row a day."""
    p = pairs.select(day, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("real", "base", "shaded")))
    up = (F.col("real") > daytime) | (F.col("base") > daytime)
    p = p.withColumn("up", up)
    mean = p.where("up").groupBy(day).agg(F.avg("real").alias("__mean"))
    p = p.join(mean, day, "left")
    only = lambda x: F.when(F.col("up"), x)
    n = F.count_if("up")
    spread = F.sum(only((F.col("real") - F.col("__mean")) * (F.col("real") - F.col("__mean"))))
    cols = []
    for name in ("base", "shaded"):
        d = F.col(name) - F.col("real")
        cols += [F.sqrt(F.avg(only(d * d))).alias(f"rmse_{name}"), F.avg(only(F.abs(d))).alias(f"mae_{name}"), F.avg(only(d)).alias(f"mbe_{name}")]
        cols.append(F.when((n > 2) & (spread > 0), 1 - F.sum(only(d * d)) / F.when(spread > 0, spread)).alias(f"r2_{name}"))
    cols += [(F.sum(c) * 5.0 / 60.0).alias(f"{c}_wh") for c in ("real", "base", "shaded")]
    return p.groupBy(day).agg(n.alias("n_daytime"), *cols)


def change_percent(new: Column, old: Column) -> Column:
    return F.when(old == 0, 0.0).otherwise((new - old) / F.when(old != 0, old) * 100)


def performance_summary(metrics: DataFrame) -> DataFrame:
    """One row over all days: mean metrics, energies in kWh, changes in per cent, energy error in per cent."""
    s = metrics.agg(
        F.count("*").alias("days"),
        *(F.avg(f"{m}_{k}").alias(f"{m}_{k}") for m in ("rmse", "mae", "mbe", "r2") for k in ("base", "shaded")),
        *((F.sum(f"{c}_wh") / 1000).alias(f"{c}_kwh") for c in ("real", "base", "shaded")),
    )
    for m in ("rmse", "mae"):
        s = s.withColumn(f"{m}_change", change_percent(F.col(f"{m}_shaded"), F.col(f"{m}_base")))
    for k in ("base", "shaded"):
        s = s.withColumn(f"{k}_error", change_percent(F.col(f"{k}_kwh"), F.col("real_kwh")))
    return s


def bank_sum(parts: list[DataFrame], ts: str, values: list[str]) -> DataFrame:
    """Sum of sub-array forecasts over the times all of them have."""
    out = None
    for k, part in enumerate(parts):
        own = part.select(ts, *(F.col(v).alias(f"{v}__{k}") for v in values))
        out = own if out is None else out.join(own, ts)
    return out.select(ts, *(sum((F.col(f"{v}__{k}") for k in range(1, len(parts))), F.col(f"{v}__0")).alias(v) for v in values))


def energy_error(metrics: DataFrame) -> DataFrame:
    """Signed and absolute energy errors in per cent, and improvements (base - shaded; the reverse for R2)."""
    out = metrics
    for k in ("base", "shaded"):
        out = out.withColumn(f"{k}_error", change_percent(F.col(f"{k}_wh"), F.col("real_wh"))).withColumn(f"{k}_abs_error", F.abs(f"{k}_error"))
    out = out.withColumn("error_gain", F.col("base_abs_error") - F.col("shaded_abs_error"))
    for m in ("rmse", "mae"):
        out = out.withColumn(f"{m}_gain", F.col(f"{m}_base") - F.col(f"{m}_shaded"))
    return out.withColumn("r2_gain", F.col("r2_shaded") - F.col("r2_base"))
