"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column, center: float, steep: float) -> Column:
    return 1 / (1 + F.exp(-steep * (x - center)))


def no_nan(x: Column, value: float = 0.0) -> Column:
    return F.coalesce(F.nanvl(x, F.lit(value)), F.lit(value))


def last_sunday(year: Column, month: int) -> Column:
    return F.next_day(F.date_sub(F.last_day(F.make_date(year, F.lit(month), F.lit(1))), 7), "SU")


def civil_offset(day: Column) -> Column:
    """Whole hours from UTC of a day's local midnight under the European rule with standard time UTC+2."""
    y = F.year(day)
    return F.when((day > last_sunday(y, 3)) & (day <= last_sunday(y, 10)), 3).otherwise(2)


def hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n)


def once(df: DataFrame) -> DataFrame:
    """The same rows; the optimiser can't copy the columns' expressions into later ones across the explode."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("__row")).select("__row.*")
