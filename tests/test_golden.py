"""Hand-made cases with known answers, and invariants."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliofield.functions import civil_offset, last_sunday
from heliofield.operators import forensics, geometry, graph, matrix, neighbours, points, pv, rays, series, stats, sun, voxel
from heliofield.plans import proxies, registry

GRID = "ix long, iy long, iz long, cls int"
CLOUD = "pid long, x double, y double, z double, cls int"


def cells(df):
    return {(r.ix, r.iy, r.iz): r.cls for r in df.collect()}


def ts(text):
    return dt.datetime.strptime(text, "%Y-%m-%d %H:%M")


def test_ground_fill_stops_at_the_next_voxel(spark):
    grid = spark.createDataFrame([(0, 0, 5, 2), (0, 0, 3, 2)], GRID)
    assert set(cells(voxel.fill_below(grid, 2))) == {(0, 0, 5), (0, 0, 4), (0, 0, 3)}
    assert set(cells(voxel.fill_below(grid, 2, every=True))) == {(0, 0, k) for k in range(6)}


def test_building_fill_replaces_vegetation(spark):
    got = cells(voxel.infill(spark.createDataFrame([(0, 0, 2, 4), (0, 0, 6, 6)], GRID)))
    assert got == {(0, 0, k): 6 for k in range(7)}
    assert cells(voxel.infill(spark.createDataFrame([(0, 0, 2, 4), (0, 0, 4, 2)], GRID))) == {(0, 0, 2): 4, (0, 0, 3): 2, (0, 0, 4): 2}


BOX = "mx double, my double, mz double, nx long, ny long, nz long"


def one_ray(spark, origin, direction):
    o, d = origin, np.array(direction, float) / np.linalg.norm(direction)
    return spark.createDataFrame([(0, 0.0, 0.0, 0, 0, *map(float, o), *map(float, d))], "array_id int, alt double, az double, panel int, ray int, ox double, oy double, oz double, dx double, dy double, dz double")


def through(spark, origin, direction, grid, n=(5, 5, 8), **how):
    box = spark.createDataFrame([(0.0, 0.0, 0.0, *n)], BOX)
    cloud = spark.createDataFrame(grid, GRID + ", lad double")
    ray = one_ray(spark, origin, direction)
    a = rays.transmittance(rays.segments(ray, box, 2.0), cloud, **how).first().t
    b = rays.march(ray, cloud, box, 2.0, **{k: v for k, v in how.items() if k == "skip"}).first().t
    assert a == pytest.approx(b, abs=1e-12)
    return a


def test_vertical_ray_through_vegetation(spark):
    leaves = [(2, 2, k, 4, 0.5) for k in (3, 4, 5)]
    assert through(spark, (5, 5, 0.5), (0, 0, 1), leaves) == pytest.approx(math.exp(-(1 / 2.08) * 0.5 * 0.5 * 6))


def test_self_occlusion_and_blocking(spark):
    assert through(spark, (5, 5, 0.5), (0, 0, 1), [(2, 2, 1, 6, 0.0)]) == 1.0
    assert through(spark, (5, 5, 0.5), (0, 0, 1), [(2, 2, 4, 6, 0.0)]) == 0.0
    assert through(spark, (5, 5, 0.5), (0, 0, 1), [(2, 2, 4, 6, 0.0)], skip=20.0) == 1.0
    assert through(spark, (-3, 5, 0.5), (1, 0, 1), [(2, 2, 4, 6, 0.0)]) == 1.0  # starts outside
    assert through(spark, (5, 5, 0.5), (0, 0, 1), [(2, 2, 4, 4, 500.0)]) == 0.0  # below the smallest transmittance


def test_both_ray_forms_agree_on_random_scenes(spark):
    rng = np.random.default_rng(2)
    grid = [(int(x), int(y), int(z), int(rng.choice([2, 3, 4, 5, 6], p=[0.05, 0.3, 0.3, 0.3, 0.05])), float(rng.random())) for x in range(6) for y in range(6) for z in range(6) if rng.random() < 0.3]
    rows = []
    for k in range(400):
        o, d = rng.random(3) * 12, rng.normal(size=3)
        if k % 10 == 0:
            d = np.eye(3)[k // 10 % 3] * (1 if k % 20 else -1)
        d = d / np.linalg.norm(d)
        rows.append((0, 0.0, 0.0, 0, k, *map(float, o), *map(float, d)))
    r = spark.createDataFrame(rows, "array_id int, alt double, az double, panel int, ray int, ox double, oy double, oz double, dx double, dy double, dz double")
    box, cloud = spark.createDataFrame([(0.0, 0.0, 0.0, 6, 6, 6)], BOX), spark.createDataFrame(grid, GRID + ", lad double")
    a = {x.ray: x.t for x in rays.transmittance(rays.segments(r, box, 2.0), cloud).collect()}
    b = {x.ray: x.t for x in rays.march(r, cloud, box, 2.0).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9 and all(0 <= t <= 1 for t in a.values())


def test_panels(spark):
    got = geometry.panel_points(spark, (geometry.Array("a", (0.0, 0.0, 0.0), 0.0, 180.0, (2, 1)),)).orderBy("panel").collect()
    assert [(round(r.x, 9), round(r.y, 9), round(r.z, 9)) for r in got] == [(0.5, 1.6, 0), (1.5, 1.6, 0), (0.5, 0, 0)]
    right = geometry.panel_points(spark, (geometry.Array("a", (0.0, 0.0, 0.0), 0.0, 180.0, (2,), "right"),)).orderBy("panel").collect()
    assert [round(r.x, 9) for r in right] == [-1.5, -0.5]
    with pytest.raises(ValueError):
        geometry.Array("a", (0.0, 0.0, 0.0), 0.0, 180.0, (2,), labels=("1",))


def test_cone_stays_near_its_axis(spark):
    cone = geometry.cone_directions(geometry.directions(spark, [0.0, 45.0, 89.9], [10.0, 200.0]), geometry.cone_offsets(spark, 16)).collect()
    dirs = {(r.alt, r.az): np.array([r.dx, r.dy, r.dz]) for r in geometry.directions(spark, [0.0, 45.0, 89.9], [10.0, 200.0]).collect()}
    for r in cone:
        v = np.array([r.dx, r.dy, r.dz])
        assert np.linalg.norm(v) == pytest.approx(1)
        assert math.degrees(math.acos(min(1, v @ dirs[r.alt, r.az]))) <= 0.266


@pytest.mark.parametrize("n", [2, 3])
def test_smoothing_clamps_edges(spark, n):
    rng = np.random.default_rng(n)
    m = rng.random((6, 7))
    frame = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(6) for j in range(7)], "alt int, az int, shadow double")
    offsets = range(-(n // 2), n - n // 2)
    want = np.mean([[m[np.clip(np.arange(6) + a, 0, 5)][:, np.clip(np.arange(7) + b, 0, 6)] for b in offsets] for a in offsets], axis=(0, 1))
    got = {(r.alt, r.az): r.shadow for r in matrix.smooth(frame, n, n).collect()}
    assert max(abs(got[i, j] - want[i, j]) for i in range(6) for j in range(7)) < 1e-12 and all(0 <= v <= 1 for v in got.values())


def test_inverter_power(spark):
    rows = [("2021-06-01 10:00", 1, 10.0), ("2021-06-01 10:05", 2, 20.0), ("2021-06-01 10:05", 3, 1.0), ("2021-06-01 10:05", 4, 0.0), ("2021-06-01 10:35", 5, 50.0), ("2021-06-02 00:00", 6, None)]
    log = spark.createDataFrame([(ts(t), i, e) for t, i, e in rows], "t timestamp_ntz, event_id long, e double")
    got = {r.event_id: r.power_w for r in series.inverter_power(log).collect()}
    cap = 50 * 12 * 2
    assert got[2] == pytest.approx(240) and got[3] == cap and got[4] == 0 and got[5] == pytest.approx(100) and got[6] == 0
    assert got[1] == pytest.approx(10 / (5 / 60))  # the median interval
    one = series.inverter_power(log.where("event_id = 2")).first()
    assert one.power_w == pytest.approx(240)


def test_civil_offset_is_that_of_midnight(spark):
    days = ["2021-03-27", "2021-03-28", "2021-03-29", "2021-10-30", "2021-10-31", "2021-11-01"]
    got = spark.createDataFrame([(d,) for d in days], "d string").select(civil_offset(F.to_date("d")).alias("o")).collect()
    assert [r.o for r in got] == [2, 2, 3, 3, 3, 2]
    assert spark.range(1).select(last_sunday(F.lit(2021), 3).alias("d")).first().d == dt.date(2021, 3, 28)


def test_asof_carries_over_days_and_keeps_null_rows(spark):
    left = spark.createDataFrame([(ts("2021-01-01 00:00"), 1), (ts("2021-01-03 12:00"), 2), (ts("2021-01-05 00:00"), 3)], "t timestamp_ntz, k int")
    right = spark.createDataFrame([(ts("2021-01-01 12:00"), 5.0), (ts("2021-01-03 12:00"), 7.0), (ts("2021-01-04 00:00"), None)], "t timestamp_ntz, v double")
    got = {r.k: r.match for r in series.asof_backward(left, right, "t").collect()}
    assert got[1] is None and got[2].v == 7.0 and got[3].v is None and got[3].t == ts("2021-01-04 00:00")


def test_nearest_in_time_within_a_second(spark):
    noon = dt.datetime(2024, 1, 1, 12)
    at = lambda s: noon + dt.timedelta(seconds=s)
    probe = spark.createDataFrame([(noon,)], "probe timestamp_ntz")
    near = lambda rows, **how: series.nearest_in_time(spark.createDataFrame([(at(s), v) for s, v in rows], "t timestamp_ntz, v double").repartition(2), probe, "t", ["v"], 60, **how).first()
    for rows in ([(5.9, 1.0), (5.1, 2.0)], [(5.1, 2.0), (5.9, 1.0)], [(5.1, 2.0), (-4.8, 1.0), (5.1, 3.0)]):  # seconds begun: 5 and -5
        assert near(rows).v == (1.0 if rows[1][0] < 0 else 2.0)
    assert near([(-1.4, 1.0), (1.3, 2.0)]).v == 2.0  # begun 2 seconds before and 1 after
    assert near([(-1.4, 1.0), (1.3, 2.0)], rounded=True).v == 1.0  # a second either way: the earlier
    assert near([(-1.5, 1.0), (1.6, 2.0), (2.5, 3.0)], rounded=True).v == 1.0
    assert near([(3.0, 2.0), (3.0, 1.0)], rounded=True).v == 1.0
    assert near([(-3600.0, 1.0)]).v == 1.0 and near([(-3600.1, 1.0)], rounded=True).v is None


def test_day_grid_zeroes_only_missing_slots(spark):
    rows = spark.createDataFrame([(dt.date(2021, 1, 1), ts("2021-01-01 00:05"), None), (dt.date(2021, 1, 1), ts("2021-01-01 00:10"), 3.0)], "day date, t timestamp_ntz, v double")
    got = {r.t: r.v for r in series.day_grid(rows, "day", "t", ["v"]).collect()}
    assert len(got) == 288 and got[ts("2021-01-01 00:05")] is None and got[ts("2021-01-01 00:10")] == 3.0 and got[ts("2021-01-01 00:00")] == 0.0


def test_albedo(spark):
    got = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (-40.0,), (40.0,)], "t double").select(pv.albedo(F.col("t")).alias("a")).collect()
    assert [r.a for r in got] == [0.425, 0.2, 0.2, 0.65, 0.2]


def test_metrics(spark):
    day = dt.date(2021, 6, 1)
    same = spark.createDataFrame([(day, float(v), float(v), float(v)) for v in (20, 30, 50, 5)], "day date, real double, base double, shaded double")
    m = pv.day_metrics(same).first()
    assert (m.rmse_base, m.r2_base, m.n_daytime, m.real_wh) == (0, 1, 3, 105 * 5 / 60)
    assert pv.day_metrics(same.limit(2)).first().r2_base is None
    assert pv.change_percent(F.lit(1.0), F.lit(0.0)) is not None


def test_shaded_is_never_above_base(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(-10, 90), rng.uniform(0, 360), *(rng.choice([None, rng.uniform(0, 900), 0.0]) for _ in range(3)), rng.uniform(0, 4000)) for i in range(300)]
    f = spark.createDataFrame(rows, "k int, altitude double, azimuth double, dni double, dhi double, ghi double, output double")
    m = spark.createDataFrame([(a, z, rng.random()) for a in range(91) for z in range(0, 361)], "alt int, az int, shadow double")
    got = pv.apply_shadows(f, m).collect()
    assert len(got) == 300 and all(0 <= r.output_shaded <= r.output + 1e-9 for r in got)


def test_sun(spark):
    at = spark.createDataFrame([(ts("2021-06-21 10:12"),), (ts("2021-12-21 10:08"),), (ts("2021-03-20 22:00"),)], "ts timestamp_ntz")
    noon, winter, night = sun.sun_position(at).orderBy(F.month("ts") == 3, F.month("ts")).collect()
    assert noon.elevation == pytest.approx(90 - 62.98 + 23.44, abs=0.05) and noon.azimuth == pytest.approx(180, abs=1.0)
    assert winter.elevation == pytest.approx(90 - 62.98 - 23.44, abs=0.05) and winter.altitude > winter.elevation
    assert night.elevation < 0
    path = sun.sun_position(spark.createDataFrame([(dt.datetime(2003, 10, 17, 19, 30, 30),)], "ts timestamp_ntz"), lat=39.742476, lon=-105.1786).first()
    assert 90 - path.altitude == pytest.approx(50.11, abs=0.05) and path.azimuth == pytest.approx(194.34, abs=0.05)  # published example


def test_planted_offset_is_found(spark):
    days = [dt.date(2021, 6, 1) + dt.timedelta(days=i) for i in range(12)]
    rise = {r.day: r.sunrise for r in sun.sunrise_per_day(spark.createDataFrame([(d,) for d in days], "day date")).collect()}
    rows = [(rise[d] + dt.timedelta(hours=3, minutes=20 + k * 5), k, 1.0) for d in days for k in range(3)]
    got = forensics.offset_mode(forensics.day_offsets(spark.createDataFrame(rows, "t timestamp_ntz, event_id long, e double"))).first()
    assert got.offset == 3 and got.delay_min == pytest.approx(20, abs=1) and got.days == 12


def test_gaps_and_clock(spark):
    start = ts("2021-03-27 00:00")
    rows = [start + dt.timedelta(minutes=5 * i) for i in range(288 * 3)]
    rows = [t if t < ts("2021-03-28 03:00") else t + dt.timedelta(hours=1) for t in rows]
    log = spark.createDataFrame([(t, i, 1.0) for i, t in enumerate(rows)], "t timestamp_ntz, event_id long, e double")
    g = forensics.intervals(log)
    c = forensics.interval_classes(g).first()
    assert c.n == 864 and c.n_normal == 862 and c.n_large == 1
    five = spark.createDataFrame([(ts("2021-03-28 02:00"), 1, 1.0), (ts("2021-03-28 03:00"), 2, 1.0)], "t timestamp_ntz, event_id long, e double")
    five_gaps = forensics.intervals(five)
    t = forensics.dst_transitions(five, five_gaps)
    assert {(r.season, r.evidence) for r in t.collect()} == {("spring", "one_hour_gap"), ("autumn", "none")}
    assert forensics.conclusion(t, five_gaps).first().conclusion == "local_dst"


def brute_knn(q, p, k):
    d = np.sqrt(((q[:, None] - p[None]) ** 2).sum(2))
    return [sorted(range(len(p)), key=lambda j: (d[i, j], j))[:k] for i in range(len(q))]


@pytest.mark.parametrize("spread", ["even", "clumped"])
def test_knn_is_exact(spark, spread):
    rng = np.random.default_rng(4)
    p = rng.random((500, 3)) * 40 if spread == "even" else np.concatenate([rng.normal(0, 0.5, (450, 3)), rng.random((50, 3)) * 400])
    cloud = spark.createDataFrame([(i, *map(float, r), 5) for i, r in enumerate(p)], CLOUD)
    for axes in ("xy", "xyz"):
        got = {}
        for r in neighbours.knn(cloud, cloud, 7, axes).collect():
            got.setdefault(r.pid, {})[r.rank] = r.nid
        want = brute_knn(p[:, : len(axes)], p[:, : len(axes)], 7)
        assert all([got[i][k + 1] for k in range(7)] == want[i] for i in range(500))
    few = neighbours.knn(cloud.limit(3), cloud.limit(3), 7).groupBy("pid").count().collect()
    assert [r["count"] for r in few] == [3, 3, 3]


def test_eigen_features_of_known_shapes(spark):
    rng = np.random.default_rng(5)
    shapes = {"plane": np.c_[rng.random((200, 2)) * 10, np.zeros(200)], "line": np.c_[np.linspace(0, 10, 200), np.zeros((200, 2))], "ball": rng.normal(size=(200, 3))}
    for name, p in shapes.items():
        cloud = spark.createDataFrame([(i, *map(float, r), 6) for i, r in enumerate(p)], CLOUD)
        edges = cloud.select(F.lit(0).cast("long").alias("pid"), F.col("pid").alias("nid"))
        f = neighbours.eigen_features(neighbours.covariances(edges, cloud)).first()
        e = np.sort(np.linalg.eigvalsh(np.cov(p.T)))[::-1]
        assert [f.e1, f.e2, f.e3] == pytest.approx(list(np.maximum(e, 0)), abs=1e-9)
        assert {"plane": f.planarity > 0.7 and f.normal_z > 0.999, "line": f.linearity > 0.999, "ball": f.sphericity > 0.5}[name]


def test_plane_inliers(spark):
    rng = np.random.default_rng(6)
    flat = np.c_[rng.random((60, 2)) * 5, np.zeros(60)]
    wild = rng.random((60, 3)) * 5 + 100
    cloud = spark.createDataFrame([(i, *map(float, r), 5) for i, r in enumerate(np.r_[flat, wild])], CLOUD)
    got = {r.pid: r.ransac for r in neighbours.plane_inliers(cloud).collect()}
    assert all(got[i] == 1.0 for i in range(60)) and np.mean([got[i] for i in range(60, 120)]) < 0.8 and min(got.values()) >= 0.3


def scene():
    rng = np.random.default_rng(7)
    roofs = [np.c_[rng.random((900, 2)) * 9 + [x, 5], np.full(900, 6.0) + rng.normal(0, 0.01, 900)] for x in (5, 25)]
    crown = rng.normal([15, 25, 6], [1.2, 1.2, 1.2], (300, 3))
    ground = np.c_[rng.random((1500, 2)) * 40, np.zeros(1500)]
    parts = [(roofs[0], 5), (roofs[1], 5), (crown, 5), (ground, 2)]
    return [(i, *map(float, r), c) for i, (r, c) in enumerate((r, c) for p, c in parts for r in p)]


def test_two_roofs_are_kept_and_a_crown_is_not(spark):
    cloud = spark.createDataFrame(scene(), CLOUD)
    out = {r.pid: r.cls for r in neighbours.reclassify_buildings(cloud, min_size=100).collect()}
    assert len(out) == 3600 and np.mean([out[i] == 6 for i in range(1800)]) > 0.9
    assert all(out[i] == 5 for i in range(1800, 2100)) and all(out[i] == 2 for i in range(2100, 3600))
    assert {r.cls for r in neighbours.reclassify_buildings(cloud.where("cls = 2")).collect()} == {2}


def test_dbscan_and_components(spark):
    rng = np.random.default_rng(8)
    p = np.r_[rng.normal(0, 0.3, (60, 3)), rng.normal(8, 0.3, (60, 3)), rng.random((10, 3)) * 100 + 50]
    cloud = spark.createDataFrame([(i, *map(float, r), 6) for i, r in enumerate(p)], CLOUD)
    got = {r.pid: r.label for r in neighbours.dbscan(cloud, 1.0).collect()}
    assert len({got[i] for i in range(60)}) == len({got[i] for i in range(60, 120)}) == 1 and got[0] != got[60] and all(got[i] == -1 for i in range(120, 130))
    chain = spark.createDataFrame([(i, i + 1) for i in range(200) if i != 99] + [(500, 501)], "a long, b long")
    parts = {r.node: r.component for r in graph.components(chain).collect()}
    assert set(parts[i] for i in range(100)) == {0} and set(parts[i] for i in range(100, 201)) == {100} and parts[501] == 500
    with pytest.raises(NotImplementedError):
        neighbours.cluster_buildings(cloud, 1.0, hdbscan=True)


def test_region_growth_rounds(spark):
    line = spark.createDataFrame([(i, float(i) * 0.9, 0.0, 0.0, 0.6, 1.0) for i in range(12)], "pid long, x double, y double, z double, score double, normal_z double")
    got = {r.pid: r.round for r in neighbours.region_grow(line, line.where("pid = 0")).collect()}
    assert got == {i: i for i in range(6)}
    assert len(neighbours.region_grow(line, line.where("pid = 0"), rounds=None).collect()) == 12


def test_stats(spark):
    v = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)], "v double")
    b = stats.box_stats(v, "v").first()
    assert (b.q1, b.median, b.q3, b.whisker_low, b.whisker_high) == (2, 3, 4, 1, 7)
    k = stats.kde(v, "v").collect()
    assert len(k) == 200 and max(r.density for r in k) == 1.0
    assert stats.kde(v.limit(2), "v").count() == 0
    fit = stats.linear_fit(spark.createDataFrame([(float(x), 2.0 * x - 1) for x in range(5)], "x double, y double"), "x", "y").first()
    assert fit.equation == "y = 2.00x - 1.00"


def test_ids_of_points_past_64_bits(spark, tmp_path):
    orders = [0, 576_459, 576_460, 576_461, 9_000_000, 54_000_000]
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    rows = [(o, p, 7, n, 1.0, price, 0.0, 0.0) for o in orders for n, p, price in ((1, 19_999, 1234.5), (6, 0, 104_949.99), (7, 1_199_999, 0.01))]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = sorted((((r[0] * 8 + r[3]) * 20_000 + r[1]) * 10**8 + round(r[5] * 100)) % 2**63 for r in rows)
    assert [r.pid for r in proxies.pts(spark, str(tmp_path)).orderBy("pid").collect()] == want
    assert len(set(want)) == len(rows)
    assert registry.queries()["class_filter"](spark, str(tmp_path)).dtypes[0] == ("pid", "bigint")


def test_merge_needs_equal_formats(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2)], CLOUD)
    assert points.merge_clouds([(a, 1), (a, 1)]).count() == 2
    for bad in ([(a, 1)], [(a, 1), (a, 2)]):
        with pytest.raises(ValueError):
            points.merge_clouds(bad)
    with pytest.raises(ValueError):
        points.crop(a)
