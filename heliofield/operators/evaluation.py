"""From weather, inverter log and shadow matrix to measured and forecast power by day, and to metrics: all days in one plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliofield.functions.storage import save
from heliofield.operators import pv, series
from heliofield.operators.sun import sun_position

IRRADIANCE = ("dni", "dhi", "ghi")
#: What a missing wind speed (m/s) and air temperature (C) count as.
WIND, TEMPERATURE = 2.0, 20.0


def carry_irradiance(forecast: DataFrame, weather: DataFrame, ts: str = "t") -> DataFrame:
    """The forecast with those irradiance columns of the weather that it lacks, by equal times (null where the weather has none)."""
    missing = [c for c in IRRADIANCE if c in weather.columns and c not in forecast.columns]
    return forecast.join(weather.select(ts, *missing), ts, "left") if missing else forecast


def forecast_power(weather: DataFrame, site: pv.Site = pv.Site(), ts: str = "t") -> DataFrame:
    """(t, altitude, azimuth, output) of weather in UTC: the sun's position and the baseline model."""
    placed = sun_position(weather, ts, site.latitude, site.longitude)
    known = placed.select(ts, "altitude", "azimuth", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in IRRADIANCE), F.coalesce("temp", F.lit(TEMPERATURE)).alias("temp"), F.coalesce("wind", F.lit(WIND)).alias("wind"), "albedo")
    return pv.baseline_power(known, site).select(ts, "altitude", "azimuth", "output")


def _binned(df: DataFrame, ts: str, values: dict[str, Column]) -> DataFrame:
    return df.groupBy("day", F.window(ts, "5 minutes")["start"].alias(ts)).agg(*(F.avg(x).alias(c) for c, x in values.items()))


def measured_days(log: DataFrame, ts: str = "t", site: pv.Site = pv.Site()) -> DataFrame:
    """(day, t, real): a logger's power on the five-minute grid of its own days in civil time; slots without a row are 0."""
    local = series.logger_to_local(log.withColumn("day", F.to_date(ts)), ts, "day", site.logger_offset)
    return series.day_grid(_binned(local, ts, {"real": F.col("power_w")}), "day", ts, ["real"])


def forecast_days(weather: DataFrame, matrix: DataFrame, site: pv.Site = pv.Site(), shift_minutes: float = 0.0, ts: str = "t") -> DataFrame:
    """(day, t, base, shaded): the forecast without and with shadows, shifted, in civil time, on the five-minute grid of its UTC days."""
    forecast = carry_irradiance(forecast_power(weather, site, ts), weather, ts)
    shaded = pv.apply_shadows(forecast, matrix).withColumn("day", F.to_date(ts))
    moved = series.utc_to_local(series.shift_on_grid(shaded, ts, shift_minutes), ts, "day")
    values = {"base": F.col("output") * site.efficiency, "shaded": F.col("output_shaded") * site.efficiency}
    return series.day_grid(_binned(moved, ts, values), "day", ts, list(values))


def bank_forecast_days(weather: DataFrame, arrays: list[tuple[pv.Site, DataFrame]], shift_minutes: float = 0.0, ts: str = "t") -> DataFrame:
    """(day, t, base, shaded) of a bank: the sum over its sub-arrays, each with its own site parameters and shadow matrix."""
    parts = [forecast_days(weather, m, site, shift_minutes, ts).withColumnsRenamed({"base": f"base{k}", "shaded": f"shaded{k}"}) for k, (site, m) in enumerate(arrays)]
    met = reduce(lambda a, b: a.join(b, ["day", ts]), parts)
    total = lambda c: reduce(lambda a, b: a + b, (F.col(f"{c}{k}") for k in range(len(arrays))))
    return met.select("day", ts, total("base").alias("base"), total("shaded").alias("shaded"))


def matched_days(measured: DataFrame, forecast: DataFrame, ts: str = "t") -> DataFrame:
    """(day, t, real, base, shaded) of the forecast's days; a day without a log counts as no power."""
    met = forecast.join(measured, ["day", ts], "left")
    return met.select("day", ts, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("real", "base", "shaded")))


def evaluate_days(days: DataFrame, log: DataFrame, load_weather: Callable[[DataFrame], DataFrame], arrays: list[tuple[pv.Site, DataFrame]], shift_minutes: float = 0.0, ts: str = "t") -> tuple[DataFrame, DataFrame]:
    """(pairs, metrics) of the listed days that have weather.

    ``days``: day. ``load_weather`` takes the days and returns their weather in UTC (t, dni, dhi, ghi, temp, wind, albedo); days it returns nothing for are
    left out. ``log`` has power_w; all sub-arrays in ``arrays`` feed the one logger."""
    weather = load_weather(days)
    # every sub-array reads the weather twice, and metrics read the pairs twice
    weather = save(weather.withColumn("day", F.to_date(ts)).join(days.select("day").distinct(), "day", "left_semi").drop("day"), "weather")
    pairs = save(matched_days(measured_days(log, ts, arrays[0][0]), bank_forecast_days(weather, arrays, shift_minutes, ts), ts), "pairs")
    return pairs, pv.day_metrics(pairs)
