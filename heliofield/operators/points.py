"""Point-cloud filters, samples and summaries: ``pid, x, y, z, cls`` in, DataFrames out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliofield.functions.storage import save

GROUND, LOW, MEDIUM, HIGH, BUILDING = 2, 3, 4, 5, 6
VEGETATION = (LOW, MEDIUM, HIGH)
RELEVANT = (GROUND, *VEGETATION, BUILDING)


def class_filter(points: DataFrame, classes=RELEVANT) -> DataFrame:
    return points.where(F.col("cls").isin(*classes))


def bbox_crop(points: DataFrame, min_x: float, max_x: float, min_y: float, max_y: float) -> DataFrame:
    """Inclusive on all sides."""
    return points.where(F.col("x").between(min_x, max_x) & F.col("y").between(min_y, max_y))


def in_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Ray-crossing parity over the polygon's edges (half-open in y, so shared vertices count once)."""
    crossed = []
    for (x1, y1), (x2, y2) in zip(vertices, vertices[1:] + vertices[:1], strict=True):
        if y1 != y2:
            at = F.lit(float(x1)) + (y - float(y1)) * float((x2 - x1) / (y2 - y1))
            crossed.append((((y >= min(y1, y2)) & (y < max(y1, y2))) & (x < at)).cast("int"))
    return reduce(lambda a, b: a + b, crossed, F.lit(0)) % 2 == 1


def polygon_crop(points: DataFrame, vertices: list[tuple[float, float]]) -> DataFrame:
    return points.where(in_polygon(F.col("x"), F.col("y"), vertices))


def crop(points: DataFrame, bounds: tuple[float, float, float, float] | None = None, vertices=None) -> DataFrame:
    if vertices:
        return polygon_crop(points, vertices)
    if bounds is None:
        raise ValueError("crop needs bounds or a polygon")
    return bbox_crop(points, *bounds)


def radius_filter(points: DataFrame, cx: float, cy: float, radius: float) -> DataFrame:
    """Strictly inside the planar radius."""
    return points.where(F.hypot(F.col("x") - cx, F.col("y") - cy) < radius)


def candidates(points: DataFrame, min_hag: float = 2.0, max_hag: float = 50.0, classes=(1, HIGH)) -> DataFrame:
    return points.where(F.col("cls").isin(*classes) & F.col("hag").between(min_hag, max_hag))


def fallback_candidates(points: DataFrame) -> DataFrame:
    """Class 5, or class 1 where the cloud has no class 5."""
    have = points.agg(F.coalesce(F.bool_or(F.col("cls") == HIGH), F.lit(False)).alias("have"))
    return points.crossJoin(F.broadcast(have)).where(F.when(F.col("have"), F.col("cls") == HIGH).otherwise(F.col("cls") == 1)).drop("have")  # one row


def numbered(points: DataFrame, *order: str, name: str = "rn") -> DataFrame:
    """0-based dense numbers in a global order: range-partitioned sort, saved, then an offset a partition."""
    placed = save(points.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "numbered")
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    base = sizes.select("__p", "__first", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__base"))
    return placed.join(F.broadcast(base), "__p").withColumn(name, F.col("__base") + F.col("__i") - F.col("__first")).drop("__p", "__i", "__first", "__base")  # one row a partition


def stride_sample(points: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th row in order of ``pid``."""
    return numbered(points, "pid").where(F.col("rn") % step == 0).drop("rn")


def uniform_sample(points: DataFrame, n: int, seed: str = "s") -> DataFrame:
    """``n`` rows without replacement, the same on every run (order of a keyed hash)."""
    return points.withColumn("__k", F.md5(F.concat(F.lit(seed), F.col("pid").cast("string")))).orderBy("__k", "pid").limit(n).drop("__k")


def merge_clouds(clouds: list[tuple[DataFrame, int]]) -> DataFrame:
    """Union of (cloud, point format) pairs; the formats must be equal."""
    if len(clouds) < 2:
        raise ValueError("merging needs two clouds or more")
    if len({f for _, f in clouds}) > 1:
        raise ValueError("point formats differ")
    return reduce(lambda a, b: a.unionByName(b), [c for c, _ in clouds])


def class_histogram(points: DataFrame) -> DataFrame:
    counts = points.groupBy("cls").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def scene_box(points: DataFrame, size: float) -> DataFrame:
    """One row: minimum corner and grid dimensions."""
    mins = points.agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "m"), (F.max, "h"))))
    dims = [F.greatest(F.ceil((F.col(f"h{c}") - F.col(f"m{c}")) / size), F.lit(1)).cast("long").alias(f"n{c}") for c in "xyz"]
    return mins.select("mx", "my", "mz", *dims)


def roof_height(points: DataFrame, cx: float, cy: float, radius: float = 3.0, offset: float = -0.5, ground_fallback: bool = False) -> DataFrame:
    """One row: highest building point near the anchor plus the offset, or the fallback height."""
    near = F.hypot(F.col("x") - cx, F.col("y") - cy) < radius
    roof = F.max(F.when(near & (F.col("cls") == BUILDING), F.col("z")))
    other = F.median(F.when(F.col("cls") == GROUND, F.col("z"))) + 5.0 if ground_fallback else F.min("z")
    return points.agg(roof.alias("roof"), other.alias("other")).select(F.coalesce(F.col("roof") + offset, "other").alias("anchor_z"))


def lowest_percent(points: DataFrame, share: float = 0.01, least: int = 10) -> DataFrame:
    """The lowest points as pseudo-ground: share of all, ``least`` at least, in order of (z, pid)."""
    n = points.agg(F.greatest((F.count("*") * share).cast("long"), F.lit(least)).alias("n"))
    return numbered(points, "z", "pid").crossJoin(F.broadcast(n)).where(F.col("rn") < F.col("n")).drop("rn", "n")  # one row


def corridor(points: DataFrame, ox: float, oy: float, azimuth_deg: float, width: float = 5.0) -> DataFrame:
    """Points ahead of the origin along the azimuth and nearer than ``width`` to its line."""
    a = F.radians(F.lit(azimuth_deg))
    dx, dy = F.col("x") - ox, F.col("y") - oy
    out = points.withColumn("along", dx * F.sin(a) + dy * F.cos(a)).withColumn("across", F.abs(dx * F.cos(a) - dy * F.sin(a)))
    return out.where((F.col("along") > 0) & (F.col("across") < width))


def class_heights(points: DataFrame, cls: int, cx: float, cy: float, radius: float) -> DataFrame:
    near = radius_filter(points.where(F.col("cls") == cls), cx, cy, radius)
    return near.agg(F.count("*").alias("n"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.avg("z").alias("mean_z"), F.median("z").alias("median_z"))
