"""Panel arrays, solar-disc samples, cone rays and sky directions as DataFrames."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = 0.618034
SOLAR_RADIUS_DEG = 0.265


@dataclass(frozen=True)
class Array:
    """A sub-array: corner anchor, tilt, azimuth, panels per row (top row first), alignment."""

    name: str
    corner: tuple[float, float, float]
    tilt: float
    azimuth: float
    rows: tuple[int, ...]
    align: str = "left"
    labels: tuple[str, ...] = ()
    width: float = 1.0
    height: float = 1.6

    def __post_init__(self):
        if self.labels and len(self.labels) != sum(self.rows):
            raise ValueError("one label a panel")


# The published layout of the two banks (metres, ETRS-TM35FIN).
BANK1 = (Array("Bank 1", (532881.51, 6983506.91, 0.0), 12.0, 170.0, (5, 4, 3), "left", ("1-1", "1-2", "1-3", "1-4", "1-5", "1-6", "1-7", "1-8", "1-9", "1-10", "1-11", "1-12")),)
BANK2 = (
    Array("Part 1 North", (532882.93, 6983518.73, 0.0), 20.0, 260.0, (6, 2), "left", ("2-1-1", "2-1-2", "2-1-3", "2-1-4", "2-1-5", "2-1-6", "2-1-7", "2-1-8")),
    Array("Part 2 South", (532888.63, 6983503.79, 0.0), 20.0, 260.0, (4, 2), "right", ("2-2-1", "2-2-2", "2-2-3", "2-2-4", "2-2-5", "2-2-6")),
)
NOMINAL_W = {"Bank 1": 3960.0, "Bank 2": 4620.0}


def array_table(spark: SparkSession, arrays: tuple[Array, ...]) -> DataFrame:
    """The specification, one row a panel label, with nested rows kept."""
    rows = [(a.name, a.azimuth, a.tilt, a.corner[0], a.corner[1], list(a.rows), a.align, list(a.labels)) for a in arrays]
    return spark.createDataFrame(rows, "array string, azimuth double, tilt double, corner_x double, corner_y double, rows array<int>, align string, labels array<string>")


def panel_points(spark: SparkSession, arrays: tuple[Array, ...], anchor_z: DataFrame | None = None, centred: bool = False) -> DataFrame:
    """array, panel, row, pos, x, y, z: panel centres. ``anchor_z``: one row with the height to stand on.

    ``centred``: the older placement, centred on the anchor with each row beginning at its left edge."""
    spec = spark.createDataFrame(
        [(k, a.name, *a.corner, a.tilt, a.azimuth, list(a.rows), a.align, a.width, a.height) for k, a in enumerate(arrays)],
        "array_id int, array string, cx double, cy double, cz double, tilt double, azimuth double, rows array<int>, align string, w double, h double",
    )
    n_rows = F.size("rows")
    spec = spec.withColumn("n_rows", n_rows).withColumn("before", F.transform("rows", lambda x, i: F.aggregate(F.slice("rows", F.lit(1), i), F.lit(0), lambda a, b: a + b)))
    at = spec.select("*", F.posexplode("rows").alias("row", "n")).withColumn("first", F.element_at("before", F.col("row") + 1)).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    ly = F.when(F.col("n_rows") > 1, (F.col("n_rows") - 1 - F.col("row")) * F.col("h")).otherwise((F.col("n_rows") - 1) * F.col("h"))
    if centred:
        ly = ly - (F.col("n_rows") - 1) * F.col("h") / 2
        lx = -F.col("n") * F.col("w") / 2 + F.col("pos") * F.col("w")
    else:
        lx = F.when(F.col("align") == "left", F.col("pos") * F.col("w") + F.col("w") / 2).otherwise(-(F.col("n") * F.col("w") - F.col("w") / 2) + F.col("pos") * F.col("w"))
    t, a = F.radians("tilt"), F.radians(180.0 - F.col("azimuth"))
    flat = at.withColumn("lx", lx).withColumn("ly", ly * F.cos(t)).withColumn("lz", ly * F.sin(t))
    out = flat.select(
        "array_id",
        "array",
        (F.col("first") + F.col("pos")).alias("panel"),
        "row",
        "pos",
        (F.col("lx") * F.cos(a) - F.col("ly") * F.sin(a) + F.col("cx")).alias("x"),
        (F.col("lx") * F.sin(a) + F.col("ly") * F.cos(a) + F.col("cy")).alias("y"),
        (F.col("lz") + F.col("cz")).alias("z"),
    )
    if anchor_z is not None:
        out = out.crossJoin(F.broadcast(anchor_z)).withColumn("z", F.col("z") + F.col("anchor_z")).drop("anchor_z")  # one row
    return out


def optical_center(panels: DataFrame) -> DataFrame:
    return panels.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))


def cone_offsets(spark: SparkSession, n: int = 6) -> DataFrame:
    """ray, ox, oy: points of the unit disc on a golden-angle spiral."""
    i = F.col("id")
    r, phi = F.sqrt((i + 0.5) / n), 2 * math.pi * GOLDEN * i
    return spark.range(n).select(i.cast("int").alias("ray"), (r * F.cos(phi)).alias("ox"), (r * F.sin(phi)).alias("oy"))


def directions(spark: SparkSession, altitudes: list[float], azimuths: list[float]) -> DataFrame:
    """alt, az, dx, dy, dz: unit vectors; azimuth from north, clockwise."""
    alt = spark.createDataFrame([(float(a),) for a in altitudes], "alt double")
    az = spark.createDataFrame([(float(a),) for a in azimuths], "az double")
    e, a = F.radians("alt"), F.radians("az")
    return alt.crossJoin(F.broadcast(az)).select("alt", "az", (F.cos(e) * F.sin(a)).alias("dx"), (F.cos(e) * F.cos(a)).alias("dy"), F.sin(e).alias("dz"))  # fixed angle grids


def cone_directions(dirs: DataFrame, offsets: DataFrame, radius_deg: float = SOLAR_RADIUS_DEG, normalised: bool = True) -> DataFrame:
    """Every direction's rays towards the solar disc."""
    steep = F.abs("dz") > 0.99
    ux, uy, uz = F.when(steep, F.col("dz")).otherwise(-F.col("dy")), F.when(steep, F.lit(0.0)).otherwise(F.col("dx")), F.when(steep, -F.col("dx")).otherwise(F.lit(0.0))
    out = dirs.withColumn("ux", ux).withColumn("uy", uy).withColumn("uz", uz)
    n = F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz"))
    out = out.withColumn("un", n)
    for c in "xyz":
        out = out.withColumn(f"u{c}", F.col(f"u{c}") / F.col("un"))
    cross = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    for c, (p, q) in cross.items():
        out = out.withColumn(f"v{c}", F.col(f"d{p}") * F.col(f"u{q}") - F.col(f"d{q}") * F.col(f"u{p}"))
    rad = math.radians(radius_deg)
    out = out.crossJoin(F.broadcast(offsets))  # a fixed number of samples
    for c in "xyz":
        out = out.withColumn(f"r{c}", F.col(f"d{c}") + rad * (F.col("ox") * F.col(f"u{c}") + F.col("oy") * F.col(f"v{c}")))
    norm = F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry") + F.col("rz") * F.col("rz")) if normalised else F.lit(1.0)
    return out.withColumn("__n", norm).select("alt", "az", "ray", *((F.col(f"r{c}") / F.col("__n")).alias(f"d{c}") for c in "xyz"))
