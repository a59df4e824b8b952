"""Distribution summaries of metric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliofield.operators.points import numbered


def box_stats(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, and whiskers at 1.5 IQR clamped to the extremes; one row."""
    q = df.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), *(F.percentile(column, F.lit(p)).alias(k) for p, k in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))))
    iqr = F.col("q3") - F.col("q1")
    return q.select("n", "q1", "median", "q3", F.greatest("low", F.col("q1") - 1.5 * iqr).alias("whisker_low"), F.least("high", F.col("q3") + 1.5 * iqr).alias("whisker_high"))


def spread(df: DataFrame, before: str, after: str) -> DataFrame:
    """Mean and sample deviation of both columns and how many rows improved (after < before)."""
    return df.agg(*(f(c).alias(f"{k}_{c}") for c in (before, after) for k, f in (("mean", F.avg), ("std", F.stddev_samp))), F.count_if(F.col(after) < F.col(before)).alias("improved"), F.count("*").alias("n"))


def kde(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """x, density: Gaussian kernel with Scott's bandwidth, scaled to a maximum of 1, on a grid over the range; empty below three rows.

    Each row meets the fixed grid in its own task and is summed per grid point before the shuffle."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    facts = values.agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"), F.stddev_samp("v").alias("s")).where("n >= 3 and s > 0").withColumn("h", F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    met = values.crossJoin(F.broadcast(facts)).select("v", "a", "b", "h", i.alias("i"))  # one row of facts
    x = F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (points - 1)
    z = (x - F.col("v")) / F.col("h")
    sums = met.withColumn("x", x).groupBy("i", "x").agg(F.sum(F.exp(-0.5 * z * z)).alias("k"))
    top = sums.agg(F.max("k").alias("top"))
    return sums.crossJoin(F.broadcast(top)).select("i", "x", (F.col("k") / F.col("top")).alias("density"))  # one row


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line, R2 of predicting y by x itself, and the line as text."""
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    mean = own.agg(F.avg(y).alias("__mean"))
    out = own.crossJoin(F.broadcast(mean)).agg(  # one row
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.sum((F.col(y) - F.col(x)) * (F.col(y) - F.col(x))).alias("res"),
        F.sum((F.col(y) - F.col("__mean")) * (F.col(y) - F.col("__mean"))).alias("tot"),
    )
    sign = F.when(F.col("intercept") < 0, "-").otherwise("+")
    return out.select("slope", "intercept", F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).alias("r2"), F.format_string("y = %.2fx %s %.2f", F.col("slope"), sign, F.abs("intercept")).alias("equation"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles, one row a column."""
    stats = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns)))
    long = df.select(stats.alias("s")).select("s.*")
    facts = long.groupBy("column").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    known = quartiles(long.where("v is not null"))
    return facts.join(known, "column", "left").select("column", "count", "mean", "std", "min", *QUARTILES, "max")


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def quartiles(long: DataFrame) -> DataFrame:
    """Exact quartiles of v, one row a column (both not null), by rows' numbers in a sort over ranges, so no task holds a column's values. Columns are few."""
    rows = numbered(long.select("column", "v"), "column", "v")
    sizes = rows.groupBy("column").agg(F.count("*").alias("n"), F.min("rn").alias("first"))
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for k, p in QUARTILES.items()))).alias("q")
    wanted = sizes.select("column", "first", at).select("column", "first", "q.*")
    side = F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("step")
    wanted = wanted.select("column", "name", "at", "first", side).select("column", "name", "at", "step", (F.col("first") + F.col("step")).alias("rn"))
    met = rows.join(F.broadcast(wanted), ["column", "rn"])  # six rows a column
    part = F.when(F.floor("at") == F.ceil("at"), 0.5).otherwise(1 - F.abs(F.col("at") - F.col("step")))
    value = met.groupBy("column", "name").agg(F.sum(part * F.col("v")).alias("v"))
    return value.groupBy("column").pivot("name", list(QUARTILES)).agg(F.first("v"))
