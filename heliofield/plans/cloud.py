"""Queries on the proxy scene: filters, voxels, infill."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliofield.operators import points as P
from heliofield.operators import voxel as V
from heliofield.plans.proxies import PTS, duck, pts

SIZE = 2.0
POLYGON = [(10.0, 10.0), (50.0, 15.0), (45.0, 50.0), (20.0, 40.0)]


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


W = f"with pts as ({PTS})"
BOX = "box as (select min(x) as mx, min(y) as my, min(z) as mz, cast(greatest(ceil((max(x)-min(x))/2.0D), 1) as bigint) as nx, cast(greatest(ceil((max(y)-min(y))/2.0D), 1) as bigint) as ny, cast(greatest(ceil((max(z)-min(z))/2.0D), 1) as bigint) as nz from pts)"
VOX = "vox as (select pid, x, y, z, cls, cast(greatest(0, least(nx-1, floor((x-mx)/2.0D))) as bigint) as ix, cast(greatest(0, least(ny-1, floor((y-my)/2.0D))) as bigint) as iy, cast(greatest(0, least(nz-1, floor((z-mz)/2.0D))) as bigint) as iz from pts, box)"
GRID = "grid as (select ix, iy, iz, max(cls) as cls from vox where cls between 2 and 6 group by ix, iy, iz)"
COL = "col as (select ix, iy, count(*) as total, count(*) filter (where cls=2) as ground, count(*) filter (where cls in (3,4,5)) as veg from vox group by ix, iy)"
API = "api as (select *, greatest(0.01D, least(1.0D, cast(ground as double)/total)) as api, -2.08D*ln(greatest(0.01D, least(1.0D, cast(ground as double)/total))) as lai from col)"
LAD = "lad as (select v.ix, v.iy, v.iz, max(v.cls) as cls, case when max(veg) > 0 then cast(count(*) filter (where v.cls in (3,4,5)) as double)/max(veg) else 0 end * max(lai)/2.0D as lad from vox v join api on v.ix=api.ix and v.iy=api.iy group by v.ix, v.iy, v.iz)"


def fill_sql(grid: str, cls: int, out: str, every: bool = False) -> str:
    if every:
        runs = f"select ix, iy, iz as top, low from (select *, coalesce(lag(iz) over (partition by ix, iy order by iz), -1) as low from {grid} where cls >= {cls}) b where cls = {cls}"
    else:
        runs = f"select t.ix, t.iy, t.top, coalesce(max(case when g.iz < t.top and g.cls >= {cls} then g.iz end), -1) as low from (select ix, iy, max(iz) as top from {grid} where cls = {cls} group by ix, iy) t join {grid} g on t.ix=g.ix and t.iy=g.iy group by t.ix, t.iy, t.top"
    return f"""{out}f as (select ix, iy, unnest(range(low+1, top)) as iz from ({runs}) r),
{out} as (select coalesce(g.ix, f.ix) as ix, coalesce(g.iy, f.iy) as iy, coalesce(g.iz, f.iz) as iz, cast(case when f.ix is not null then {cls} else g.cls end as int) as cls from {grid} g full join {out}f f on g.ix=f.ix and g.iy=f.iy and g.iz=f.iz)"""


def voxels(spark, d):
    return V.voxelise(pts(spark, d), SIZE)


def _polygon_sql() -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True):
        parts.append(f"cast(y >= {min(y1, y2)}D and y < {max(y1, y2)}D and x < {x1}D + (y - {y1}D) * {(x2 - x1) / (y2 - y1)!r}D as int)")
    return f"({' + '.join(parts)}) % 2 = 1"


def queries():
    q = {}
    pick = "select pid, x, y, z, cls from pts where "
    q["class_filter"] = (lambda s, d: P.class_filter(pts(s, d), (2, 3, 4, 5)), f"{W} {pick} cls in (2,3,4,5)")
    q["bbox_crop"] = (lambda s, d: P.bbox_crop(pts(s, d), 10.0, 30.0, 20.0, 45.0), f"{W} {pick} x >= 10 and x <= 30 and y >= 20 and y <= 45")
    q["polygon_crop"] = (lambda s, d: P.polygon_crop(pts(s, d), POLYGON), f"{W} {pick} {_polygon_sql()}")
    q["radius_filter"] = (lambda s, d: P.radius_filter(pts(s, d), 30.0, 30.0, 7.5), f"{W} {pick} sqrt((x-30.0D)*(x-30.0D)+(y-30.0D)*(y-30.0D)) < 7.5D")
    q["fallback_candidates"] = (lambda s, d: P.fallback_candidates(pts(s, d)), f"{W} {pick} cls = case when (select count(*) from pts where cls = 5) > 0 then 5 else 1 end")
    q["stride_sample"] = (lambda s, d: P.stride_sample(pts(s, d), 7), f"{W} select pid, x, y, z, cls from (select *, row_number() over (order by pid) - 1 as rn from pts) n where rn % 7 = 0")
    q["uniform_sample"] = (lambda s, d: P.uniform_sample(pts(s, d), 1000), f"{W} select pid, x, y, z, cls from pts order by md5('s' || cast(pid as varchar)), pid limit 1000")
    q["merge_clouds"] = (lambda s, d: P.merge_clouds([(P.bbox_crop(pts(s, d), 0, 20, 0, 60), 3), (P.bbox_crop(pts(s, d), 30, 60, 0, 60), 3)]), f"{W} {pick} x <= 20 union all {pick} x >= 30")
    q["set_difference"] = (lambda s, d: pts(s, d).select("pid").exceptAll(P.bbox_crop(pts(s, d), 5.0, 55.0, 5.0, 55.0).select("pid")), f"{W} select pid from pts where not (x >= 5 and x <= 55 and y >= 5 and y <= 55)")
    q["class_histogram"] = (lambda s, d: P.class_histogram(pts(s, d)).select("cls", "n", *r6("pct")), f"{W} select cls, count(*) as n, round(100.0D*count(*)/sum(count(*)) over (), 6) as pct from pts group by cls")
    q["scene_bounds"] = (lambda s, d: P.scene_box(pts(s, d), SIZE).select(*r6("mx", "my", "mz"), "nx", "ny", "nz"), f"{W}, {BOX} select round(mx,6) as mx, round(my,6) as my, round(mz,6) as mz, nx, ny, nz from box")
    q["roof_height"] = (
        lambda s, d: P.roof_height(pts(s, d), 30.0, 30.0).select(*r6("anchor_z")),
        f"{W} select round(coalesce(max(case when cls=6 and sqrt((x-30.0D)*(x-30.0D)+(y-30.0D)*(y-30.0D)) < 3 then z end) - 0.5D, min(z)), 6) as anchor_z from pts",
    )
    q["roof_height_ground_fallback"] = (
        lambda s, d: P.roof_height(pts(s, d), 5.0, 5.0, ground_fallback=True).select(*r6("anchor_z")),
        f"{W} select round(coalesce(max(case when cls=6 and sqrt((x-5.0D)*(x-5.0D)+(y-5.0D)*(y-5.0D)) < 3 then z end) - 0.5D, median(case when cls=2 then z end) + 5.0D), 6) as anchor_z from pts",
    )
    q["lowest_percent_ground"] = (
        lambda s, d: P.lowest_percent(pts(s, d)),
        f"{W} select pid, x, y, z, cls from (select *, row_number() over (order by z, pid) as rn, count(*) over () as c from pts) n where rn <= greatest(cast(floor(c*0.01D) as bigint), 10)",
    )
    q["corridor_nearest_veg"] = (
        lambda s, d: P.corridor(P.class_filter(pts(s, d), P.VEGETATION), 30.0, 24.0, 170.0).agg(F.count("*").alias("n"), F.min_by("pid", F.struct("along", "pid")).alias("nearest"), F.max_by("pid", F.struct("z", "pid")).alias("tallest"), F.round(F.min("along"), 6).alias("min_along")),
        f"""{W}, c as (select pid, z, (x-30.0D)*sin(radians(170.0D)) + (y-24.0D)*cos(radians(170.0D)) as along, abs((x-30.0D)*cos(radians(170.0D)) - (y-24.0D)*sin(radians(170.0D))) as across from pts where cls in (3,4,5)),
f as (select * from c where along > 0 and across < 5)
select count(*) as n, (select pid from f order by along, pid limit 1) as nearest, (select pid from f order by z desc, pid desc limit 1) as tallest, round(min(along), 6) as min_along from f""",
    )
    q["class_heights_in_radius"] = (
        lambda s, d: P.class_heights(pts(s, d), 6, 30.0, 30.0, 8.0).select("n", *r6("min_z", "max_z", "mean_z", "median_z")),
        f"{W} select count(*) as n, round(min(z),6) as min_z, round(max(z),6) as max_z, round(avg(z),6) as mean_z, round(median(z),6) as median_z from pts where cls=6 and sqrt((x-30.0D)*(x-30.0D)+(y-30.0D)*(y-30.0D)) < 8",
    )
    q["voxel_class_grid"] = (lambda s, d: V.class_grid(voxels(s, d)), f"{W}, {BOX}, {VOX}, {GRID} select ix, iy, iz, cls from grid")
    q["column_counts"] = (lambda s, d: V.column_counts(voxels(s, d)), f"{W}, {BOX}, {VOX}, {COL} select ix, iy, total, ground, veg from col")
    q["column_api_lai"] = (lambda s, d: V.column_api_lai(V.column_counts(voxels(s, d))).select("ix", "iy", *r6("api", "lai")), f"{W}, {BOX}, {VOX}, {COL}, {API} select ix, iy, round(api,6) as api, round(lai,6) as lai from api")
    q["voxel_lad"] = (lambda s, d: V.voxel_lad(voxels(s, d), SIZE).select("ix", "iy", "iz", "cls", *r6("lad")), f"{W}, {BOX}, {VOX}, {COL}, {API}, {LAD} select ix, iy, iz, cls, round(lad,6) as lad from lad")
    box4 = BOX.replace("from pts", "from own").replace("box as", "obox as")
    q["api_map"] = (
        lambda s, d: V.api_map(pts(s, d), SIZE).select("ix", "iy", *r6("api")),
        f"""{W}, own as (select * from pts where cls in (2,3,4,5)), {box4}, oc as (select cast(greatest(0, least(nx-1, floor((x-mx)/2.0D))) as bigint) as ix, cast(greatest(0, least(ny-1, floor((y-my)/2.0D))) as bigint) as iy, cls from own, obox),
a as (select ix, iy, cast(count(*) filter (where cls=2) as double)/count(*) as api from oc group by ix, iy),
sp as (select ix, unnest(range(0, ny)) as iy from (select unnest(range(0, nx)) as ix, ny from obox) s)
select sp.ix, sp.iy, round(coalesce(api, 0), 6) as api from sp left join a on sp.ix=a.ix and sp.iy=a.iy""",
    )
    q["infill_ground_building"] = (lambda s, d: V.infill(V.class_grid(voxels(s, d))), f"{W}, {BOX}, {VOX}, {GRID}, {fill_sql('grid', 2, 'ga')}, {fill_sql('ga', 6, 'gb')} select ix, iy, iz, cls from gb")
    q["infill_legacy"] = (lambda s, d: V.infill(V.class_grid(voxels(s, d)), every=True), f"{W}, {BOX}, {VOX}, {GRID}, {fill_sql('grid', 2, 'ga', True)}, {fill_sql('ga', 6, 'gb', True)} select ix, iy, iz, cls from gb")
    return {k: (f, duck(sql)) for k, (f, sql) in q.items()}
