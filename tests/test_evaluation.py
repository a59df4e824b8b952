"""Weather assembly and evaluation over days against plain computations, and nearest neighbours of clumped clouds."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliofield.operators import evaluation as E
from heliofield.operators import neighbours as N
from heliofield.operators import pv, rays

DAY = dt.datetime(2021, 7, 3)
at = lambda minutes, day=0: DAY + dt.timedelta(days=day, minutes=minutes)


def matrix(spark, dark):
    return spark.range(91).withColumnRenamed("id", "alt").crossJoin(spark.range(361).withColumnRenamed("id", "az")).select(F.col("alt").cast("int").alias("alt"), F.col("az").cast("int").alias("az"), F.lit(dark).alias("shadow"))


def weather(spark, days=(0, 1)):
    rows = [(at(m, d), 400.0 + m % 7, 80.0, 300.0 + m % 11, 15.0, 3.0 if m % 2 else None, 0.2) for d in days for m in range(240, 1200, 5)]
    return spark.createDataFrame(rows, "t timestamp_ntz, dni double, dhi double, ghi double, temp double, wind double, albedo double")


def test_weather_is_filled_from_the_satellite(spark):
    ground = spark.createDataFrame([(at(0), 10.0, 2.0), (at(2), 14.0, 4.0), (at(11), None, 6.0)], "t timestamp_ntz, temp double, wind double")
    radiation = spark.createDataFrame([(at(0), 100.0, None), (at(6), None, 30.0)], "t timestamp_ntz, ghi double, dhi double")
    cams = spark.createDataFrame([(at(-3), 1.0, 11.0, 21.0), (at(5), 2.0, 12.0, 22.0), (at(12), 3.0, 13.0, 23.0)], "t timestamp_ntz, dni double, ghi double, dhi double")
    got = [tuple(r) for r in pv.weather_day(ground, radiation, cams).orderBy("t").select("t", "dni", "ghi", "dhi", "temp", "wind").collect()]
    assert got == [(at(0), 1.0, 100.0, 21.0, 12.0, 3.0), (at(5), 2.0, 12.0, 30.0, None, None), (at(10), 2.0, 12.0, 22.0, None, 6.0)]
    bare = pv.weather_day(ground.drop("wind"), radiation, None).orderBy("t").first()
    assert (bare.dni, bare.wind, bare.albedo) == (0.0, None, 0.2)


def test_irradiance_is_carried_by_time(spark):
    forecast = spark.createDataFrame([(at(0), 5.0, 7.0), (at(5), 6.0, 8.0)], "t timestamp_ntz, output double, ghi double")
    got = E.carry_irradiance(forecast, weather(spark).withColumn("t", F.when(F.col("t") == at(240), F.lit(at(0))).otherwise(F.col("t")))).orderBy("t").collect()
    assert [(r.ghi, r.dni, r.dhi) for r in got] == [(7.0, 402.0, 80.0), (8.0, None, None)]
    assert E.carry_irradiance(forecast.withColumns({"dni": F.lit(1), "dhi": F.lit(1)}), weather(spark)).columns == ["t", "output", "ghi", "dni", "dhi"]


def test_days_are_evaluated_with_loaded_weather(spark):
    log = spark.createDataFrame([(at(m, d), float(m % 13) * 90) for d in (0, 1, 2) for m in range(300, 1100, 5)], "t timestamp_ntz, power_w double")
    days = spark.createDataFrame([(DAY.date(),), ((DAY + dt.timedelta(days=2)).date(),)], "day date")  # the second has no weather
    one, two = pv.Site(nominal_w=2000.0), pv.Site(nominal_w=1000.0, tilt=30.0)
    asked = []

    def load(wanted):
        asked.extend(r.day for r in wanted.orderBy("day").collect())
        return weather(spark, (0, 1))

    pairs, metrics = E.evaluate_days(days, log, load, [(one, matrix(spark, 0.25)), (two, matrix(spark, 0.5))], -30.0)
    assert asked == [r.day for r in days.orderBy("day").collect()]
    rows = {r.t: r for r in pairs.collect()}
    assert len(rows) == 288 and {r.day for r in rows.values()} == {DAY.date()}
    alone = [{r.t: r for r in E.forecast_days(weather(spark, (0,)), matrix(spark, dark), site, -30.0).collect()} for site, dark in ((one, 0.25), (two, 0.5))]
    for t, r in rows.items():
        assert r.base == pytest.approx(alone[0][t].base + alone[1][t].base) and r.shaded == pytest.approx(alone[0][t].shaded + alone[1][t].shaded)
        assert r.shaded <= r.base + 1e-9
    # a slot by hand: UTC + 3 h in July, half an hour earlier; the logger's clock is civil time then
    source = {r.t: r for r in weather(spark, (0,)).collect()}
    t = at(600)
    w = source[t - dt.timedelta(hours=3) + dt.timedelta(minutes=30)]
    sun = E.forecast_power(weather(spark, (0,)).where(F.col("t") == F.lit(w.t)), one).first()
    alt, az, tilt = math.radians(sun.altitude), math.radians(sun.azimuth), math.radians(one.tilt)
    incidence = max(math.sin(alt) * math.cos(tilt) + math.cos(alt) * math.sin(tilt) * math.cos(az - math.radians(one.azimuth)), 0)
    plane = w.dni * incidence + w.dhi * (1 + math.cos(tilt)) / 2 + w.ghi * w.albedo * (1 - math.cos(tilt)) / 2
    cell = w.temp + plane * 25 / 800 * 9.5 / (5.7 + 3.8 * (w.wind or 2.0))
    assert alone[0][t].base == pytest.approx(0.95 * plane / 1000 * 2000 * (1 - 0.004 * (cell - 25)))
    assert rows[t].real == float(600 % 13) * 90
    m = metrics.collect()
    assert len(m) == 1 and m[0].day == DAY.date()
    up = [r for r in rows.values() if r.real > 10 or r.base > 10]
    assert m[0].n_daytime == len(up) and m[0].rmse_base == pytest.approx(math.sqrt(np.mean([(r.base - r.real) ** 2 for r in up])))


def brute(queries, points, k):
    d = np.sqrt(((queries[:, None, 1:] - points[None, :, 1:]) ** 2).sum(2))
    out = {}
    for i, q in enumerate(queries):
        order = np.lexsort((points[:, 0], np.round(d[i], 12)))[:k]
        out[int(q[0])] = [(int(points[j, 0]), round(float(d[i, j]), 9)) for j in order]
    return out


@pytest.mark.parametrize("k", [1, 4])
def test_neighbours_of_a_clumped_cloud(spark, k):
    """A third of the points in a thousandth of the width: cells adapt, results stay exact."""
    rng = np.random.default_rng(4)
    wide, clump = rng.random((400, 3)) * 100, 50 + rng.random((200, 3)) * 0.1
    points = np.column_stack([np.arange(600), np.concatenate((wide, clump))])
    frame = spark.createDataFrame([(int(p[0]), *map(float, p[1:])) for p in points], "pid long, x double, y double, z double")
    got = {}
    for r in N.knn(frame, frame, k).orderBy("pid", "rank").collect():
        got.setdefault(r.pid, []).append((r.nid, round(r.dist, 9)))
    assert got == brute(points, points, k)


def test_large_grids_are_met_by_segments(spark):
    box = spark.createDataFrame([(0.0, 0.0, 0.0, 6, 6, 6)], "mx double, my double, mz double, nx long, ny long, nz long")
    grid = spark.createDataFrame([(x, y, z, 5, 0.3) for x in range(6) for y in range(6) for z in (2, 3)] + [(1, 1, 5, 6, 0.0)], "ix long, iy long, iz long, cls int, lad double")
    r = spark.createDataFrame([("a", 0.0, 0.0, 1, k, 3.0 + k, 3.0, 0.5, math.sin(0.1 * k), 0.0, math.cos(0.1 * k)) for k in range(6)], "array_id string, alt double, az double, panel int, ray int, ox double, oy double, oz double, dx double, dy double, dz double")
    one = {x.ray: x.t for x in rays.march(r, grid, box, 2.0).collect()}
    two = {x.ray: x.t for x in rays.march(r, grid, box, 2.0, most_bytes=1).collect()}
    assert set(one) == set(two) == set(range(6))
    assert all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one) and any(x < 1 for x in one.values())


def test_describe_holds_no_column_in_a_task(spark):
    """Quartiles by numbers of sorted rows: no aggregate that keeps all values of a column."""
    from heliofield.operators import stats

    v = np.random.default_rng(3).normal(0, 5, 401)
    rows = spark.createDataFrame([(float(x), None if i % 3 else float(round(x)), None) for i, x in enumerate(v)], "a double, b double, c double").repartition(4)
    out = stats.describe(rows, ["a", "b", "c"])
    assert "percentile" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["column"]: r for r in out.collect()}
    for name, own in (("a", v), ("b", np.round(v[::3]))):
        r = got[name]
        assert [r["count"], r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]] == pytest.approx([len(own), own.mean(), own.std(ddof=1), own.min(), *np.quantile(own, [0.25, 0.5, 0.75]), own.max()])
    assert got["c"]["count"] == 0 and got["c"]["p50"] is None
