"""Ray attenuation through a sparse voxel grid.

A ray's segments are made in its own row (plane crossings as arrays, sorted, exploded), so making them needs no join or shuffle; segments meet
the grid in one equi-join, and a ray's transmittance is an order-independent aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliofield.functions import once
from heliofield.operators.points import BUILDING, GROUND, VEGETATION

K_BASE = 1 / 2.08
BUFFER = 0.1
SKIP = 3.0
RAY_KEY = ("array_id", "alt", "az", "panel", "ray")


def leaf_projection(cos_zenith: Column) -> Column:
    """Spherical leaf angles: one half for every direction. Any ``Column -> Column`` may stand in its place."""
    return F.lit(0.5)


def rays_of(panels: DataFrame, cone: DataFrame) -> DataFrame:
    """Every panel's rays, dealt out by direction; panels are a specification of a few rows."""
    origins = panels.select("array_id", "panel", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"))
    return cone.repartition("alt", "az").crossJoin(F.broadcast(origins))


def _crossing(d: Column, s: Column, m: Column, size: float) -> Callable[[Column], Column]:
    return lambda plane: (m + plane * size - s) / d


def segments(rays: DataFrame, box: DataFrame, size: float, buffer: float = BUFFER) -> DataFrame:
    """Ray columns + t0, length, ix, iy, iz, near (voxel touches the origin's), outside (the ray starts outside)."""
    r = rays.crossJoin(F.broadcast(box))  # one row
    for c in "xyz":
        r = r.withColumn(f"s{c}", F.col(f"o{c}") + F.col(f"d{c}") * buffer)
    for c in "xyz":
        r = r.withColumn(f"v{c}", F.floor((F.col(f"s{c}") - F.col(f"m{c}")) / size)).withColumn(f"w{c}", F.floor((F.col(f"o{c}") - F.col(f"m{c}")) / size))
    outside = F.lit(False)
    for c in "xyz":
        outside = outside | (F.col(f"v{c}") < 0) | (F.col(f"v{c}") >= F.col(f"n{c}"))
    r = once(r.withColumn("outside", outside))
    ends, planes = [], []
    for c in "xyz":
        d, s, m, n, v = (F.col(f"{k}{c}") for k in "dsmnv")
        moving = F.abs(d) >= 1e-12
        at = _crossing(d, s, m, size)
        ends.append(F.when(moving, at(F.when(d > 0, n).otherwise(F.lit(0)))).otherwise(F.lit(float("inf"))))
        steps = F.when(d > 0, F.sequence(v + 1, n)).otherwise(F.sequence(v, F.lit(0).cast("long")))
        planes.append(F.when(moving & ~F.col("outside"), F.transform(steps, at)).otherwise(F.array().cast("array<double>")))
    r = once(r.withColumn("t_end", F.least(*ends)).withColumn("planes", F.concat(F.array(F.lit(0.0)), *planes)))
    cuts = F.array_sort(F.filter("planes", lambda t: t <= F.col("t_end")))
    pairs = F.arrays_zip(F.slice("cuts", F.lit(1), F.size("cuts") - 1).alias("a"), F.slice("cuts", F.lit(2), F.size("cuts") - 1).alias("b"))
    # an outside ray keeps one empty segment, so that it keeps its row
    seg = once(r.withColumn("cuts", F.when(F.col("outside"), F.array(F.lit(0.0), F.lit(0.0))).otherwise(cuts)).drop("planes")).withColumn("p", F.explode(pairs))
    seg = seg.withColumn("t0", F.col("p.a")).withColumn("length", F.col("p.b") - F.col("p.a")).where("length > 0 or outside")
    for c in "xyz":
        seg = seg.withColumn(f"i{c}", F.floor((F.col(f"s{c}") + F.col(f"d{c}") * ((F.col("p.a") + F.col("p.b")) / 2) - F.col(f"m{c}")) / size))
    near = F.greatest(*(F.abs(F.col(f"i{c}") - F.col(f"w{c}")) for c in "xyz")) <= 1
    keep = [c for c in rays.columns if c not in ("ox", "oy", "oz", "dx", "dy")]
    return seg.select(*keep, "t0", "length", "ix", "iy", "iz", near.alias("near"), "outside")


def transmittance(segs: DataFrame, grid: DataFrame, skip: float = SKIP, buffer: float = BUFFER, k: float = K_BASE, g: Callable[[Column], Column] = leaf_projection, key=RAY_KEY) -> DataFrame:
    """One row a ray: T in 0..1. Solid voxels block unless they are in the self-occlusion zone; vegetation attenuates."""
    key = [c for c in key if c in segs.columns]
    hit = segs.join(grid.select("ix", "iy", "iz", "cls", "lad"), ["ix", "iy", "iz"], "left")
    solid = F.col("cls").isin(GROUND, BUILDING) & ~F.col("near") & ~(F.col("t0") + buffer < skip)
    depth = F.when(F.col("cls").isin(*VEGETATION), k * g(F.col("dz")) * F.col("lad") * F.col("length")).otherwise(0.0)
    per = hit.groupBy(*key).agg(F.bool_or(F.coalesce(solid, F.lit(False))).alias("blocked"), F.sum(depth).alias("depth"), F.bool_or("outside").alias("outside"))
    t = F.exp(-F.col("depth"))
    return per.select(*key, F.when(F.col("outside"), 1.0).when(F.col("blocked") | (t < 1e-6), 0.0).otherwise(t).alias("t"))


def sky_sweep(per_ray: DataFrame) -> DataFrame:
    """array_id, alt, az, shadow = 1 - mean over panels and rays; the horizon row is fully shaded, azimuth 360 repeats 0."""
    mean = per_ray.groupBy("array_id", "alt", "az").agg((1 - F.avg("t")).alias("shadow"))
    mean = mean.withColumn("shadow", F.when(F.radians("alt") < 0.001, 1.0).otherwise(F.col("shadow")))
    return mean.unionByName(mean.where("az = 0").withColumn("az", F.lit(360.0)))


def column_probe(columns: DataFrame, grid: DataFrame, probes: DataFrame, box: DataFrame, size: float) -> DataFrame:
    """Column statistics at probe points (distance, x, y)."""
    at = probes.crossJoin(F.broadcast(box))  # one row
    for c in "xy":
        at = at.withColumn(f"i{c}", F.floor((F.col(c) - F.col(f"m{c}")) / size))
    tops = grid.groupBy("ix", "iy").agg(F.max("lad").alias("max_lad"), F.count_if(F.col("lad") > 0).alias("layers"))
    return at.select("distance", "ix", "iy").join(columns, ["ix", "iy"], "left").join(tops, ["ix", "iy"], "left").select("distance", "total", "veg", "api", "lai", "max_lad", "layers")


def trace(segs: DataFrame, grid: DataFrame, limit: int = 20) -> DataFrame:
    """The first vegetation voxels of one ray, in order."""
    hit = segs.join(grid.select("ix", "iy", "iz", "cls", "lad"), ["ix", "iy", "iz"])
    return hit.where(F.col("cls").isin(*VEGETATION)).orderBy("t0").limit(limit).select("t0", "length", "ix", "iy", "iz", "cls", "lad")


def march(rays: DataFrame, grid: DataFrame, box: DataFrame, size: float, skip: float = SKIP, buffer: float = BUFFER, k: float = K_BASE, g: float = 0.5, most_bytes: int = 256 << 20) -> DataFrame:
    """The same per-ray transmittance by stepping Arrow batches of rays through a dense copy of the grid.

    The dense grid is sent to the tasks only if it has at most ``most_bytes``; a larger one is met by segments in a join."""
    b = box.first()
    dims = np.array([b["nx"], b["ny"], b["nz"]])
    if math.prod(dims.tolist()) * 9 > most_bytes:
        key = [c for c in rays.columns if c not in ("ox", "oy", "oz", "dx", "dy", "dz")]
        return transmittance(segments(rays, box, size, buffer), grid, skip, buffer, k, lambda _: F.lit(g), key)
    cells = grid.select("ix", "iy", "iz", "cls", "lad").toArrow()
    cls, lad = np.zeros(dims, np.int8), np.zeros(dims, np.float64)
    index = tuple(np.asarray(cells.column(c)) for c in ("ix", "iy", "iz"))
    cls[index], lad[index] = np.asarray(cells.column("cls")), np.nan_to_num(np.asarray(cells.column("lad"), dtype=float))
    sent = rays.sparkSession.sparkContext.broadcast((cls, lad, np.array([b["mx"], b["my"], b["mz"]])))
    key = [c for c in rays.columns if c not in ("ox", "oy", "oz", "dx", "dy", "dz")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, lad, low = sent.value
        for batch in batches:
            o, d = (np.stack([np.asarray(batch.column(f"{p}{c}"), dtype=float) for c in "xyz"], 1) for p in "od")
            start, home = o + d * buffer, np.floor((o - low) / size).astype(int)
            voxel = np.floor((start - low) / size).astype(int)
            out, alive = np.ones(len(o)), ((voxel >= 0) & (voxel < dims)).all(1)
            depth, t = np.zeros(len(o)), np.zeros(len(o))
            step = np.sign(d).astype(int)
            with np.errstate(divide="ignore", invalid="ignore"):
                ahead = np.where(np.abs(d) < 1e-12, np.inf, (low + (voxel + (step > 0)) * size - start) / d)
                width = np.where(np.abs(d) < 1e-12, np.inf, size / np.abs(d))
            rows = np.arange(len(o))
            while alive.any():
                axis = ahead.argmin(1)
                nxt = ahead[rows, axis]
                i = np.clip(voxel, 0, dims - 1)
                c, a = cls[i[:, 0], i[:, 1], i[:, 2]], lad[i[:, 0], i[:, 1], i[:, 2]]
                crossed = nxt > t
                solid = alive & crossed & ((c == GROUND) | (c == BUILDING)) & (np.abs(voxel - home).max(1) > 1) & ~(t + buffer < skip)
                depth += np.where(alive & crossed & np.isin(c, VEGETATION), k * g * a * (nxt - t), 0.0)
                out[solid] = 0.0
                alive &= ~solid
                t = np.where(alive, nxt, t)
                voxel[rows, axis] += step[rows, axis]
                ahead[rows, axis] += width[rows, axis]
                alive &= ((voxel >= 0) & (voxel < dims)).all(1)
            out = np.where(out > 0, np.exp(-depth), 0.0)
            out[out < 1e-6] = 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), pa.array(out)], names=[*key, "t"])

    schema = rays.select(*key).schema.add("t", "double")
    return rays.mapInArrow(walk, schema)
