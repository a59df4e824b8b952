"""Sparse voxel grids: class, column rasters, leaf-area density, infill below surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliofield.operators.points import BUILDING, GROUND, RELEVANT, VEGETATION, scene_box

BETA = 2.08


def voxelise(points: DataFrame, size: float, box: DataFrame | None = None) -> DataFrame:
    """Adds ix, iy, iz, clipped to the scene box."""
    box = scene_box(points, size) if box is None else box
    out = points.crossJoin(F.broadcast(box))  # one row
    for c in "xyz":
        out = out.withColumn(f"i{c}", F.greatest(F.lit(0), F.least(F.col(f"n{c}") - 1, F.floor((F.col(c) - F.col(f"m{c}")) / size))).cast("long"))
    return out.drop("mx", "my", "mz", "nx", "ny", "nz")


def class_grid(voxels: DataFrame) -> DataFrame:
    """Class of each occupied voxel: the highest priority, which is the highest class of 2 to 6."""
    return voxels.where(F.col("cls").isin(*RELEVANT)).groupBy("ix", "iy", "iz").agg(F.max("cls").alias("cls"))


def column_counts(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("ix", "iy").agg(F.count("*").alias("total"), F.count_if(F.col("cls") == GROUND).alias("ground"), F.count_if(F.col("cls").isin(*VEGETATION)).alias("veg"))


def column_api_lai(columns: DataFrame, beta: float = BETA) -> DataFrame:
    """Gap fraction (API), clipped to 0.01..1, and leaf-area index."""
    api = F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.when(F.col("total") > 0, F.col("ground") / F.col("total")).otherwise(1.0)))
    return columns.withColumn("api", api).withColumn("lai", -beta * F.ln("api"))


def voxel_lad(voxels: DataFrame, size: float, beta: float = BETA) -> DataFrame:
    """ix, iy, iz, cls, lad: class and leaf-area density of every occupied voxel, in one pass per aggregate."""
    relevant = voxels.where(F.col("cls").isin(*RELEVANT))
    cells = relevant.groupBy("ix", "iy", "iz").agg(F.max("cls").alias("cls"), F.count_if(F.col("cls").isin(*VEGETATION)).alias("v"), F.count("*").alias("n"), F.count_if(F.col("cls") == GROUND).alias("g"))
    column = Window.partitionBy("ix", "iy")
    api = F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.sum("g").over(column) / F.sum("n").over(column)))
    veg = F.sum("v").over(column)
    share = F.when(veg > 0, F.col("v") / veg).otherwise(0.0)
    return cells.select("ix", "iy", "iz", "cls", (share * (-beta * F.ln(api)) / size).alias("lad"))


def _overlay(grid: DataFrame, fill: DataFrame, cls: int) -> DataFrame:
    both = grid.join(fill.withColumn("__f", F.lit(True)), ["ix", "iy", "iz"], "full")
    return both.select("ix", "iy", "iz", F.when(F.col("__f"), F.lit(cls)).otherwise(F.col("cls")).cast("int").alias("cls"), *([F.coalesce("lad", F.lit(0.0)).alias("lad")] if "lad" in grid.columns else []))


def fill_below(grid: DataFrame, cls: int, every: bool = False) -> DataFrame:
    """Set voxels below the column's topmost voxel of ``cls`` to it, down to the first of equal or higher priority.

    ``every``: start from each voxel of the class (the older rule)."""
    column = Window.partitionBy("ix", "iy")
    if every:
        blockers = grid.where(F.col("cls") >= cls)
        under = F.lag("iz").over(column.orderBy("iz"))
        runs = blockers.withColumn("low", F.coalesce(under, F.lit(-1))).where(F.col("cls") == cls).select("ix", "iy", F.col("iz").alias("top"), "low")
    else:
        top = F.max(F.when(F.col("cls") == cls, F.col("iz"))).over(column)
        runs = grid.withColumn("top", top).where("top is not null").groupBy("ix", "iy", "top").agg(F.coalesce(F.max(F.when((F.col("iz") < F.col("top")) & (F.col("cls") >= cls), F.col("iz"))), F.lit(-1)).alias("low"))
    fill = runs.where("low + 1 <= top - 1").select("ix", "iy", F.explode(F.sequence(F.col("low") + 1, F.col("top") - 1)).alias("iz"))
    return _overlay(grid, fill, cls)


def infill(grid: DataFrame, every: bool = False) -> DataFrame:
    """Ground first, then buildings on its result."""
    return fill_below(fill_below(grid, GROUND, every), BUILDING, every)


def api_map(points: DataFrame, size: float, classes=(GROUND, *VEGETATION)) -> DataFrame:
    """Dense raster of ground/total per cell without buildings; 0 where a cell has no points."""
    own = points.where(F.col("cls").isin(*classes))
    box = scene_box(own, size)
    cells = voxelise(own, size, box).groupBy("ix", "iy").agg((F.count_if(F.col("cls") == GROUND) / F.count("*")).alias("api"))
    spine = box.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)).alias("ix"), "ny").select("ix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)).alias("iy"))
    return spine.join(cells, ["ix", "iy"], "left").select("ix", "iy", F.coalesce("api", F.lit(0.0)).alias("api"))
