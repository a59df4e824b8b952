"""Queries that write a file format into the shared folder and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heliofield.functions.packaging import ship
from heliofield.functions.storage import shared_dir
from heliofield.operators import geometry as G
from heliofield.plans.cloud import W, r6
from heliofield.plans.proxies import INV, MATRIX, TEMP, duck, frame, matrix, pts
from heliofield.sources import las, tables


def _place(s, name):
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex[:12]}"


def _spread(df):
    """The same rows, alike in number, over as many tasks as a shuffle has: compression takes its time by the point, and a table's row groups may be few or unlike."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def matrix_csv(s, d):
    path = _place(s, "matrix")
    tables.write_shadow_matrix(matrix(s, d), path)
    return tables.read_shadow_matrix(s, path).select("alt", "az", *r6("shadow"))


def las_round_trip(s, d):
    ship(s)
    las.register(s)
    path = _place(s, "las")
    pts(s, d).select("x", "y", "z", F.col("cls").cast("int").alias("cls")).write.format("las").mode("append").save(path)
    back = s.read.format("las").option("points_per_partition", "20000").load(path).where("cls = 6")
    return back.select(F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round("z", 3).alias("z"), "cls").groupBy("cls").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("sx"), F.round(F.sum("y"), 2).alias("sy"))


def _by_class(df):
    return df.groupBy("cls").agg(F.count("*").alias("n"), F.round(F.sum(F.round("x", 2)), 2).alias("sx"), F.round(F.sum(F.round("y", 2)), 2).alias("sy"))


def laz_round_trip(s, d):
    """The scene in compressed files, read back by runs of chunks."""
    ship(s)
    las.register(s)
    path = _place(s, "laz")
    _spread(pts(s, d).select("x", "y", "z", F.col("cls").cast("int").alias("cls"))).write.format("las").option("compressed", "true").option("chunk", "5000").mode("append").save(path)
    return _by_class(s.read.format("las").option("points_per_partition", "20000").load(path).where(F.col("cls").isin(3, 6)))


def las_merge_kept(s, d):
    """Two compressed tiles as one cloud with high vegetation made medium: all else of their records is kept."""
    ship(s)
    las.register(s)
    tiles, merged = _place(s, "tiles"), _place(s, "merged")
    for side in ("x < 30", "x >= 30"):
        _spread(pts(s, d).where(side).select("x", "y", "z", F.col("cls").cast("int").alias("cls"))).write.format("las").option("compressed", "true").option("chunk", "5000").mode("append").save(tiles)
    cloud = s.read.format("las").option("record", "true").load(tiles)
    changed = cloud.withColumn("cls", F.when(F.col("cls") == 5, 4).otherwise(F.col("cls")).cast("int"))
    changed.write.format("las").option("like", tiles).mode("append").save(merged)
    return _by_class(s.read.format("las").load(merged))


def inverter_csv(s, d):
    path = _place(s, "inverter")
    rows = frame(s, d, INV).select(F.date_format("t", "dd.MM.yyyy HH:mm").alias("Date and time"), F.lit("x").alias("Status"), F.concat(F.lit(" "), F.col("e").cast("string"), F.lit(" ")).alias("Energy [Wh]"))
    rows.write.option("header", True).csv(path)
    return tables.read_inverter(s, path, "Energy").groupBy(F.to_date("t").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("e"), 4).alias("e"))


def inverter_all_csv(s, d):
    path = _place(s, "inverter-all")
    rows = frame(s, d, INV).select(F.date_format("t", "dd.MM.yyyy HH:mm").alias("Date and time"), F.when(F.col("e") % 3 < 1, "n/a").otherwise(F.col("event_id").cast("string")).alias("Status"), F.col("e").cast("string").alias("Energy [Wh]"))
    rows.write.option("header", True).csv(path)
    every = tables.read_inverter_all(s, path)
    return every.groupBy(F.to_date("t").alias("day")).agg(F.count("Status").alias("n"), F.sum("Status").cast("long").alias("status"), F.round(F.sum("Energy [Wh]"), 4).alias("e"))


def cached_weather(s, d):
    """Cached days, with two digits and an albedo made anew from each one's mean temperature."""
    path = _place(s, "weather")
    rows = frame(s, d, TEMP).where("temp is not null").select(F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.lit(1.234).alias("dni"), F.lit(2.345).alias("dhi"), (F.col("wind") * 10).alias("ghi"), F.col("temp").alias("T"), "wind", F.lit(0.9).alias("albedo"))
    rows.write.option("header", True).csv(path)
    return tables.read_cached_weather(s, path).select("ts", *r6("dni", "dhi"), F.round(F.col("T") - F.round("T", 2), 6).alias("rest"), "albedo")


def clear_minutes(s, d):
    path = _place(s, "minutes")
    frame(s, d, INV).select(F.date_format("t", "yyyy MM dd HH mm").alias("value")).write.text(path)
    return tables.read_clear_minutes(s, path)


def observations(s, d):
    path = _place(s, "observations")
    one = frame(s, d, INV).groupBy("t").agg(F.max("e").alias("e"))
    rows = one.select(F.year("t").alias("Year"), F.month("t").alias("Month"), F.dayofmonth("t").alias("Day"), F.date_format("t", "HH:mm").alias("Time [UTC]"), F.when(F.minute("t") % 10 == 0, "-").otherwise(F.col("e").cast("string")).alias("Air temperature [degC]"))
    rows.write.option("header", True).csv(path)
    return tables.read_observations(s, path, {"Air temperature [degC]": "temp"}).select("ts", *r6("temp"))


def queries():
    q = {}
    q["shadow_matrix_csv"] = (matrix_csv, f"select alt, az, round(shadow, 6) as shadow from ({MATRIX}) m")
    q["las_round_trip"] = (las_round_trip, f"{W} select cls, count(*) as n, round(sum(x), 2) as sx, round(sum(y), 2) as sy from pts where cls = 6 group by cls")
    by_class = "count(*) as n, round(sum(x), 2) as sx, round(sum(y), 2) as sy"
    q["laz_round_trip"] = (laz_round_trip, f"{W} select cls, {by_class} from pts where cls in (3, 6) group by cls")
    q["las_merge_kept"] = (las_merge_kept, f"{W} select cast(case when cls = 5 then 4 else cls end as int) as cls, {by_class} from pts group by 1")
    q["inverter_csv"] = (inverter_csv, f"with i0 as ({INV}) select cast(t as date) as day, count(*) as n, round(sum(e), 4) as e from i0 group by 1")
    q["inverter_all_csv"] = (inverter_all_csv, f"with i0 as ({INV}), x as (select cast(t as date) as day, case when e % 3 < 1 then null else event_id end as st, e from i0) select day, count(st) as n, cast(sum(st) as bigint) as status, round(sum(e), 4) as e from x group by 1")
    mean = "avg(round(temp, 2))"
    q["cached_weather_csv"] = (cached_weather, f"with tw as ({TEMP}), w as (select * from tw where temp is not null), a as (select cast(t as date) as d, {mean} as m from w group by 1) select t as ts, 1.23D as dni, 2.35D as dhi, 0.0D as rest, round(0.65D/(1+exp((m-1)/0.75D)) + 0.2D*(1-1/(1+exp((m-1)/0.75D))), 3) as albedo from w join a on a.d = cast(w.t as date)")
    q["clear_minutes_text"] = (clear_minutes, f"with i0 as ({INV}) select cast(t as date) as day, count(*) as n from i0 group by 1")
    q["observation_csv"] = (observations, f"with i0 as ({INV}), o as (select t, max(e) as e from i0 group by t) select t as ts, case when minute(t) % 10 = 0 then null else round(e, 6) end as temp from o")
    q["study_area_wkt"] = (
        lambda s, d: tables.study_area(pts(s, d).agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))),
        f"{W}, b as (select min(x) as a, max(x) as b, min(y) as c, max(y) as d from pts) select printf('POLYGON ((%.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f))', a, c, b, c, b, d, a, d, a, c) as wkt from b",
    )
    q["array_layout"] = (
        lambda s, d: G.array_table(s, G.BANK1 + G.BANK2).select("array", "azimuth", "tilt", "align", F.size("labels").alias("panels"), F.aggregate("rows", F.lit(0), lambda a, b: a + b).alias("places")),
        "select * from (values ('Bank 1', 170.0D, 12.0D, 'left', 12, 12), ('Part 1 North', 260.0D, 20.0D, 'left', 8, 8), ('Part 2 South', 260.0D, 20.0D, 'right', 6, 6)) v(\"array\", azimuth, tilt, align, panels, places)",
    )
    q["sample_metrics"] = (
        lambda s, d: tables.sample_metrics(s).select("Date", *r6("rmse_base", "rmse_shaded")),
        "select strftime(date '2021-05-01' + cast(i as int), '%Y-%m-%d') as Date, round(500.0D+10*((i*37)%21),6) as rmse_base, round((500+10*((i*37)%21))*(0.6D+((i*13)%7)/20.0D),6) as rmse_shaded from (select unnest(range(0, 20)) as i) s",
    )
    return {k: (f, duck(sql)) for k, (f, sql) in q.items()}
