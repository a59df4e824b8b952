"""Logger forensics: interval classes, day anomalies, clock changes, offset detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliofield.functions import last_sunday
from heliofield.operators.series import with_previous
from heliofield.operators.sun import sunrise_per_day

PER_DAY, SLACK = 288, 2


def intervals(log: DataFrame, ts: str = "t", tie: str = "event_id") -> DataFrame:
    """Adds prev_t and gap_min (null in the first row)."""
    rows = with_previous(log.where(F.col(ts).isNotNull()), ts, [ts], [ts, tie])
    prev = F.col("prev")[ts]
    gap = (F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(prev.cast("timestamp"))) / 60.0
    return rows.withColumn("prev_t", prev).withColumn("gap_min", gap).drop("prev")


def interval_class(gap: Column) -> Column:
    return (
        F.when(gap.isNull(), F.lit(None))
        .when(F.abs(gap - 5) < 0.5, "normal")
        .when(F.abs(gap - 60) < 0.5, "one_hour")
        .when(gap > 60.5, "large")
        .when(F.abs(gap) < 0.5, "duplicate")
        .when(gap < -0.5, "backwards")
        .otherwise("other")
    )


def interval_classes(gaps: DataFrame) -> DataFrame:
    """One row: span, rows, and a count a class (backwards stays 0, rows are in order)."""
    kinds = ("normal", "one_hour", "large", "duplicate", "backwards", "other")
    return gaps.withColumn("kind", interval_class(F.col("gap_min"))).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds))


def top_gaps(gaps: DataFrame, kind: str, k: int) -> DataFrame:
    """The k longest intervals of a class."""
    return gaps.where(interval_class(F.col("gap_min")) == kind).orderBy(F.desc("gap_min"), "t", "event_id").limit(k).select("prev_t", "t", "gap_min")


def day_anomalies(log: DataFrame, ts: str = "t") -> DataFrame:
    counts = log.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    kind = F.when(F.col("n") < PER_DAY - SLACK, "short").when(F.col("n") > PER_DAY + SLACK, "long")
    return counts.withColumn("kind", kind).where("kind is not null")


def duplicate_members(log: DataFrame, ts: str = "t") -> DataFrame:
    """All rows whose time occurs more than once."""
    twice = log.groupBy(ts).agg(F.count("*").alias("n")).where("n > 1")
    return log.join(twice, ts)


def dst_transitions(log: DataFrame, gaps: DataFrame, ts: str = "t") -> DataFrame:
    """One row a year and season: the expected date and what the log shows on it.

    Autumn: a backwards step, then duplicates, then more records than a day has, or none. Spring: a one-hour gap that ends at 3 or 4 o'clock."""
    years = log.select(F.year(ts).alias("year")).distinct()
    dates = years.select("year", last_sunday(F.col("year"), 3).alias("spring"), last_sunday(F.col("year"), 10).alias("autumn"))
    wanted = dates.select("year", F.explode(F.array(F.struct(F.lit("spring").alias("season"), F.col("spring").alias("day")), F.struct(F.lit("autumn").alias("season"), F.col("autumn").alias("day")))).alias("s")).select("year", "s.*")
    kind = interval_class(F.col("gap_min"))
    seen = gaps.groupBy(F.to_date(ts).alias("day")).agg(
        F.count("*").alias("records"),
        F.count_if(kind == "duplicate").alias("duplicates"),
        F.count_if(kind == "backwards").alias("backwards"),
        F.count_if((kind == "one_hour") & F.hour(ts).isin(3, 4)).alias("spring_gaps"),
    )
    met = wanted.join(seen, "day", "left")
    autumn = F.when(F.col("backwards") > 0, "backwards").when(F.col("duplicates") > 0, "duplicates").when(F.col("records") > PER_DAY + SLACK, "long_day").otherwise("none")
    spring = F.when(F.col("spring_gaps") > 0, "one_hour_gap").otherwise("none")
    return met.select("year", "season", "day", F.coalesce("records", F.lit(0)).alias("records"), F.when(F.col("season") == "autumn", autumn).otherwise(spring).alias("evidence"))


def conclusion(transitions: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: local_dst with spring gaps on expected dates, else fixed, with downtime if any interval is large."""
    spring = transitions.agg(F.count_if((F.col("season") == "spring") & (F.col("evidence") != "none")).alias("spring"))
    large = gaps.agg(F.count_if(interval_class(F.col("gap_min")).isin("large", "one_hour")).alias("large"))
    return spring.crossJoin(large).select("spring", "large", F.when(F.col("spring") > 0, "local_dst").when(F.col("large") > 0, "fixed_with_downtime").otherwise("fixed").alias("conclusion"))  # one row each


def first_onset(log: DataFrame, ts: str = "t", energy: str = "e", threshold: float = 0.05) -> DataFrame:
    return log.where(F.col(energy) > threshold).groupBy(F.to_date(ts).alias("day")).agg(F.min(ts).alias("onset"))


def day_offsets(log: DataFrame, ts: str = "t", energy: str = "e", threshold: float = 0.05) -> DataFrame:
    """day, onset, sunrise, offset_hours: the onset of production less the sunrise in UTC."""
    onset = first_onset(log, ts, energy, threshold)
    rise = sunrise_per_day(onset.select("day"))
    sec = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return onset.join(rise, "day").withColumn("offset_hours", (sec("onset") - sec("sunrise")) / 3600.0)


def offset_histogram(offsets: DataFrame) -> DataFrame:
    counts = offsets.groupBy(F.rint("offset_hours").cast("int").alias("offset")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def offset_mode(offsets: DataFrame) -> DataFrame:
    """One row: the most frequent rounded offset (the smallest on a tie), the median inside its bin, and the start-up delay."""
    rounded = offsets.withColumn("offset", F.rint("offset_hours").cast("int"))
    mode = rounded.agg(F.mode("offset", True).alias("offset"))
    inside = rounded.join(F.broadcast(mode), "offset")  # one row
    return inside.groupBy("offset").agg(F.median("offset_hours").alias("median_hours"), F.count("*").alias("days")).withColumn("delay_min", (F.col("median_hours") - F.col("offset")) * 60)


def seasonal_offset(offsets: DataFrame) -> DataFrame:
    """One row: medians of rounded offsets in winter and summer months, and whether they differ by 0.8 h."""
    winter = F.month("day").isin(1, 2, 3, 10, 11, 12)
    r = F.rint("offset_hours")
    m = offsets.agg(F.median(F.when(winter, r)).alias("winter"), F.median(F.when(~winter, r)).alias("summer"))
    return m.withColumn("shifted", F.coalesce(F.abs(F.col("winter") - F.col("summer")) >= 0.8, F.lit(False)))


def landmarks(series: DataFrame, value: str, ts: str = "t", level: float = 100.0) -> DataFrame:
    """Per day: the time of the maximum, the first time above a level, and means at midnight and noon."""
    return series.groupBy(F.to_date(ts).alias("day")).agg(F.min_by(ts, F.struct(-F.col(value), ts)).alias("peak_at"), F.min(F.when(F.col(value) > level, F.col(ts))).alias("above_at"), F.avg(F.when(F.hour(ts) == 0, F.col(value))).alias("mean_0h"), F.avg(F.when(F.hour(ts) == 12, F.col(value))).alias("mean_12h"))
