"""Queries on panels, cones, rays and sky sweeps over the proxy scene."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliofield.operators import geometry as G
from heliofield.operators import points as P
from heliofield.operators import rays as R
from heliofield.operators import voxel as V
from heliofield.plans import cloud
from heliofield.plans.cloud import API, BOX, COL, GRID, LAD, SIZE, VOX, W, fill_sql, r6
from heliofield.plans.proxies import duck, pts

#: The grid of the SQL twins; the sweep itself has every degree (the horizon's row is shaded without tracing).
ALTS, AZS = [float(a) for a in range(5, 90, 10)], [float(a) for a in range(0, 360, 30)]
ALL_ALTS, ALL_AZS = [float(a) for a in range(1, 91)], [float(a) for a in range(360)]
LOCAL = (G.Array("Bank 1", (28.0, 24.0, 0.0), 12.0, 170.0, (5, 4, 3)),)
TWO = (G.Array("North", (22.0, 28.0, 107.0), 20.0, 260.0, (6, 2)), G.Array("South", (36.0, 32.0, 107.0), 20.0, 260.0, (4, 2), "right"))


def grid_of(spark, d):
    """Class and density of the infilled scene."""
    return V.infill(V.voxel_lad(cloud.voxels(spark, d), SIZE))


def box_of(spark, d):
    return P.scene_box(pts(spark, d), SIZE)


def panels_of(spark, d):
    return G.panel_points(spark, LOCAL, P.roof_height(pts(spark, d), 30.0, 27.0))


def rays_of(spark, d, alts=ALTS, azs=AZS, n=6, panels=None):
    cone = G.cone_directions(G.directions(spark, alts, azs), G.cone_offsets(spark, n))
    return R.rays_of(panels_of(spark, d) if panels is None else panels, cone)


def per_ray(spark, d, panels=None):
    return R.transmittance(R.segments(rays_of(spark, d, panels=panels), box_of(spark, d), SIZE), grid_of(spark, d))


def whole_rays(spark, d, panels=None, top=90.0):
    return rays_of(spark, d, [a for a in ALL_ALTS if a <= top], ALL_AZS, panels=panels)


def per_ray_whole(spark, d, panels=None, top=90.0):
    """Every traced direction, by the kernel, which meets a grid that is too large for the tasks by segments."""
    return R.march(whole_rays(spark, d, panels, top), grid_of(spark, d), box_of(spark, d), SIZE)


def sweep_whole(spark, d, panels=None, top=90.0):
    """array_id, alt, az, shadow: 91 x 361 rows an array, up to ``top`` degrees."""
    panels = panels_of(spark, d) if panels is None else panels
    arrays = panels.select("array_id").distinct()
    horizon = arrays.crossJoin(F.broadcast(spark.createDataFrame([(0.0, a) for a in ALL_AZS], "alt double, az double"))).withColumn("t", F.lit(0.0))  # 360 rows
    return R.sky_sweep(per_ray_whole(spark, d, panels, top).select("array_id", "alt", "az", "t").unionByName(horizon))


def whole():
    """The jobs over all 91 x 360 directions; no SQL, its segments are too many there."""
    return {
        "ray_segments_whole": lambda s, d: R.segments(whole_rays(s, d), box_of(s, d), SIZE).groupBy("alt", "az", "panel").agg(F.count("*").alias("n"), F.round(F.sum("length"), 6).alias("length"), F.count_if("near").alias("near")),
        "ray_transmittance_whole": lambda s, d: R.transmittance(R.segments(whole_rays(s, d), box_of(s, d), SIZE), grid_of(s, d)).select("alt", "az", "panel", "ray", *r6("t")),
        "ray_transmittance_kernel_whole": lambda s, d: R.march(whole_rays(s, d), grid_of(s, d), box_of(s, d), SIZE).select("alt", "az", "panel", "ray", *r6("t")),
        "sky_sweep_whole": lambda s, d: sweep_whole(s, d).select("alt", "az", *r6("shadow")),
        "sky_sweep_two_arrays_whole": lambda s, d: sweep_whole(s, d, G.panel_points(s, TWO)).select("array_id", "alt", "az", *r6("shadow")),
    }


def offset_sweep(spark, d):
    """Voxel layer of panels and roof for a list of height offsets, and the offset that clears the roof's layer."""
    box = box_of(spark, d)
    roof = P.roof_height(pts(spark, d), 30.0, 30.0, offset=0.0).select(F.col("anchor_z").alias("roof"))
    offsets = spark.createDataFrame([(x / 2,) for x in range(-5, 7)], "offset double")
    at = offsets.crossJoin(F.broadcast(roof.crossJoin(box)))  # one row
    layer = lambda z: F.floor((z - F.col("mz")) / SIZE)
    ideal = SIZE - F.pmod(F.col("roof") - F.col("mz"), F.lit(SIZE)) + 0.1
    return at.select("offset", layer(F.col("roof") + F.col("offset")).alias("panel_layer"), layer(F.col("roof")).alias("roof_layer"), F.round(ideal, 6).alias("ideal_offset"))


def probe(spark, d):
    dist = spark.createDataFrame([(float(x),) for x in range(5, 31, 5)], "distance double")
    a = F.radians(F.lit(170.0))
    probes = dist.select("distance", (30.0 + F.col("distance") * F.sin(a)).alias("x"), (30.0 + F.col("distance") * F.cos(a)).alias("y"))
    cols = V.column_api_lai(V.column_counts(cloud.voxels(spark, d)))
    return R.column_probe(cols, V.voxel_lad(cloud.voxels(spark, d), SIZE), probes, box_of(spark, d), SIZE).select("distance", "total", "veg", *r6("api", "lai", "max_lad"), "layers")


def kernel_rays(spark, d):
    return R.march(rays_of(spark, d), grid_of(spark, d), box_of(spark, d), SIZE)


def panels_sql(arrays, name, anchor: str | None) -> str:
    values = ", ".join(f"({k}, '{a.name}', {a.corner[0]}D, {a.corner[1]}D, {a.corner[2]}D, {a.tilt}D, {a.azimuth}D, {len(a.rows)}, {i}, {n}, {sum(a.rows[:i])}, '{a.align}')" for k, a in enumerate(arrays) for i, n in enumerate(a.rows))
    z = f"+ (select anchor_z from {anchor})" if anchor else ""
    return f"""{name}_r(array_id, arr, cx, cy, cz, tilt, azimuth, n_rows, row, n, first, align) as (values {values}),
{name}_l as (select *, case when align = 'left' then pos*1.0D + 0.5D else -(n*1.0D - 0.5D) + pos*1.0D end as lx, (n_rows-1-row)*1.6D*cos(radians(tilt)) as ly, (n_rows-1-row)*1.6D*sin(radians(tilt)) as lz
  from (select *, unnest(range(0, n)) as pos from {name}_r) r),
{name} as (select array_id, cast(first + pos as int) as panel, row, cast(pos as int) as pos, lx*cos(radians(180.0D-azimuth)) - ly*sin(radians(180.0D-azimuth)) + cx as x, lx*sin(radians(180.0D-azimuth)) + ly*cos(radians(180.0D-azimuth)) + cy as y, lz + cz {z} as z from {name}_l)"""


ROOF = "roof as (select coalesce(max(case when cls=6 and sqrt((x-30.0D)*(x-30.0D)+(y-27.0D)*(y-27.0D)) < 3 then z end) - 0.5D, min(z)) as anchor_z from pts)"
OFFS = "offs as (select cast(i as int) as ray, sqrt((i+0.5D)/6.0D)*cos(2*pi()*0.618034D*i) as ox, sqrt((i+0.5D)/6.0D)*sin(2*pi()*0.618034D*i) as oy from (select unnest(range(0, 6)) as i) s)"
DIRS = "dirs as (select alt, az, cos(radians(alt))*sin(radians(az)) as dx, cos(radians(alt))*cos(radians(az)) as dy, sin(radians(alt)) as dz from (select cast(unnest(range(5, 90, 10)) as double) as alt) a cross join (select cast(unnest(range(0, 360, 30)) as double) as az) z)"
CONE = """base as (select *, ux/sqrt(ux*ux+uy*uy+uz*uz) as ax, uy/sqrt(ux*ux+uy*uy+uz*uz) as ay, uz/sqrt(ux*ux+uy*uy+uz*uz) as az_ from (select *, case when abs(dz) > 0.99D then dz else -dy end as ux, case when abs(dz) > 0.99D then 0.0D else dx end as uy, case when abs(dz) > 0.99D then -dx else 0.0D end as uz from dirs) u),
raw as (select alt, az, ray, dx + radians(0.265D)*(ox*ax + oy*(dy*az_-dz*ay)) as rx, dy + radians(0.265D)*(ox*ay + oy*(dz*ax-dx*az_)) as ry, dz + radians(0.265D)*(ox*az_ + oy*(dx*ay-dy*ax)) as rz from base cross join offs),
cone as (select alt, az, ray, rx/sqrt(rx*rx+ry*ry+rz*rz) as dx, ry/sqrt(rx*rx+ry*ry+rz*rz) as dy, rz/sqrt(rx*rx+ry*ry+rz*rz) as dz from raw)"""


def segment_sql(panels: str) -> str:
    axis = lambda c: f"select k, s{c} as s, d{c} as d, m{c} as m, n{c} as n, v{c} as v from ray where not outside and abs(d{c}) >= 1e-12"
    ends = ", ".join(f"case when abs(d{c}) >= 1e-12 then (m{c} + (case when d{c} > 0 then n{c} else 0 end)*2.0D - s{c})/d{c} else cast('inf' as double) end" for c in "xyz")
    planes = " union all ".join(f"select k, (m + p*2.0D - s)/d as t from (select *, unnest(case when d > 0 then range(v+1, n+1) else range(0, v+1) end) as p from ({axis(c)}) a) b" for c in "xyz")
    mids = ", ".join(f"cast(floor((s{c} + d{c}*((t0+t1)/2) - m{c})/2.0D) as bigint) as i{c}" for c in "xyz")
    return f"""ray0 as (select array_id, alt, az, panel, ray, x as ox, y as oy, z as oz, dx, dy, dz, x+dx*0.1D as sx, y+dy*0.1D as sy, z+dz*0.1D as sz from {panels} cross join cone),
ray1 as (select *, row_number() over () as k, {", ".join(f"cast(floor((s{c}-m{c})/2.0D) as bigint) as v{c}, cast(floor((o{c}-m{c})/2.0D) as bigint) as w{c}" for c in "xyz")} from ray0, box),
ray as (select *, {" or ".join(f"v{c} < 0 or v{c} >= n{c}" for c in "xyz")} as outside, least({ends}) as t_end from ray1),
cuts as (select k, 0.0D as t from ray union all {planes}),
lead_ as (select c.k, t as t0, lead(t) over (partition by c.k order by t) as t1 from cuts c join ray r on c.k = r.k where t <= t_end),
seg as (select r.k, array_id, alt, az, panel, ray, dz, outside, t0, t1-t0 as length, wx, wy, wz, {mids} from lead_ l join ray r on l.k = r.k where t1 > t0 and not outside)"""


HIT = """hit as (select k, max(case when g.cls in (2,6) and not greatest(abs(s.ix-wx), abs(s.iy-wy), abs(s.iz-wz)) <= 1 and not t0 + 0.1D < 3.0D then 1 else 0 end) as blocked,
  sum(case when g.cls in (3,4,5) then (1/2.08D)*0.5D*lad*length else 0 end) as depth from seg s left join g on s.ix=g.ix and s.iy=g.iy and s.iz=g.iz group by k),
tr as (select array_id, alt, az, panel, ray, case when outside then 1.0D when blocked = 1 or exp(-depth) < 1e-6 then 0.0D else exp(-depth) end as t from ray left join hit on ray.k = hit.k)"""
SCENE = f"{W}, {BOX}, {VOX}, {GRID}, {COL}, {API}, {LAD}, {fill_sql('grid', 2, 'ga')}, {fill_sql('ga', 6, 'gb')}, g as (select gb.ix, gb.iy, gb.iz, gb.cls, coalesce(lad.lad, 0) as lad from gb left join lad on gb.ix=lad.ix and gb.iy=lad.iy and gb.iz=lad.iz)"
LIGHT = f"{SCENE}, {ROOF}, {panels_sql(LOCAL, 'panels', 'roof')}, {OFFS}, {DIRS}, {CONE}, {segment_sql('panels')}"
SWEEP = "m as (select array_id, alt, az, 1 - avg(t) as shadow from tr group by array_id, alt, az), sw as (select * from m union all select array_id, alt, 360.0D as az, shadow from m where az = 0)"


def queries():
    q = {k: (f, "") for k, f in whole().items()}
    q["panel_points"] = (
        lambda s, d: G.panel_points(s, G.BANK1 + G.BANK2, P.roof_height(pts(s, d), 30.0, 27.0)).select("array_id", "panel", "row", "pos", *r6("x", "y", "z")),
        f"{W}, {ROOF}, {panels_sql(G.BANK1 + G.BANK2, 'panels', 'roof')} select array_id, panel, row, pos, round(x,6) as x, round(y,6) as y, round(z,6) as z from panels",
    )
    q["optical_center"] = (lambda s, d: G.optical_center(panels_of(s, d)).select(*r6("x", "y", "z")), f"{W}, {ROOF}, {panels_sql(LOCAL, 'panels', 'roof')} select round(avg(x),6) as x, round(avg(y),6) as y, round(avg(z),6) as z from panels")
    q["cone_offsets"] = (lambda s, d: G.cone_offsets(s).select("ray", *r6("ox", "oy")), f"with {OFFS} select ray, round(ox,6) as ox, round(oy,6) as oy from offs")
    q["cone_directions"] = (lambda s, d: G.cone_directions(G.directions(s, ALTS, AZS), G.cone_offsets(s)).select("alt", "az", "ray", *r6("dx", "dy", "dz")), f"with {OFFS}, {DIRS}, {CONE} select alt, az, ray, round(dx,6) as dx, round(dy,6) as dy, round(dz,6) as dz from cone")
    q["ray_segments"] = (
        lambda s, d: R.segments(rays_of(s, d), box_of(s, d), SIZE).groupBy("alt", "az", "panel").agg(F.count("*").alias("n"), F.round(F.sum("length"), 6).alias("length"), F.count_if("near").alias("near")),
        f"{LIGHT} select alt, az, panel, count(*) as n, round(sum(length),6) as length, count(*) filter (where greatest(abs(ix-wx), abs(iy-wy), abs(iz-wz)) <= 1) as near from seg group by alt, az, panel",
    )
    q["ray_transmittance"] = (lambda s, d: per_ray(s, d).select("alt", "az", "panel", "ray", *r6("t")), f"{LIGHT}, {HIT} select alt, az, panel, ray, round(t,6) as t from tr")
    q["ray_transmittance_kernel"] = (lambda s, d: kernel_rays(s, d).select("alt", "az", "panel", "ray", *r6("t")), f"{LIGHT}, {HIT} select alt, az, panel, ray, round(t,6) as t from tr")
    q["sky_sweep"] = (lambda s, d: R.sky_sweep(per_ray(s, d)).select("alt", "az", *r6("shadow")), f"{LIGHT}, {HIT}, {SWEEP} select alt, az, round(shadow,6) as shadow from sw")
    two = f"{SCENE}, {panels_sql(TWO, 'panels', None)}, {OFFS}, {DIRS}, {CONE}, {segment_sql('panels')}, {HIT}, {SWEEP} select array_id, alt, az, round(shadow,6) as shadow from sw"
    q["sky_sweep_two_arrays"] = (lambda s, d: R.sky_sweep(per_ray(s, d, G.panel_points(s, TWO))).select("array_id", "alt", "az", *r6("shadow")), two)
    q["placement_sweep"] = (
        offset_sweep,
        f"""{W}, {BOX}, roof as (select max(case when cls=6 and sqrt((x-30.0D)*(x-30.0D)+(y-30.0D)*(y-30.0D)) < 3 then z end) as r from pts)
select i/2.0D as "offset", cast(floor((r + i/2.0D - mz)/2.0D) as bigint) as panel_layer, cast(floor((r - mz)/2.0D) as bigint) as roof_layer, round(2.0D - ((r-mz) - floor((r-mz)/2.0D)*2.0D) + 0.1D, 6) as ideal_offset from (select unnest(range(-5, 7)) as i) s, box, roof""",
    )
    q["column_probe"] = (
        probe,
        f"""{W}, {BOX}, {VOX}, {COL}, {API}, {LAD}, p as (select dist, cast(floor((30.0D + dist*sin(radians(170.0D)) - mx)/2.0D) as bigint) as ix, cast(floor((30.0D + dist*cos(radians(170.0D)) - my)/2.0D) as bigint) as iy from (select cast(unnest(range(5, 31, 5)) as double) as dist) s, box),
tops as (select ix, iy, max(lad) as max_lad, count(*) filter (where lad > 0) as layers from lad group by ix, iy)
select dist as distance, total, veg, round(api,6) as api, round(lai,6) as lai, round(max_lad,6) as max_lad, layers from p left join api on p.ix=api.ix and p.iy=api.iy left join tops on p.ix=tops.ix and p.iy=tops.iy""",
    )
    one = "alt = 25 and az = 150 and panel = 11 and ray = 0"
    q["ray_trace"] = (
        lambda s, d: R.trace(R.segments(rays_of(s, d, [25.0], [150.0], panels=panels_of(s, d)).where("panel = 11 and ray = 0"), box_of(s, d), SIZE), grid_of(s, d)).select("ix", "iy", "iz", "cls", *r6("t0", "length", "lad")),
        f"{LIGHT} select ix, iy, iz, cls, round(t0,6) as t0, round(length,6) as length, round(lad,6) as lad from (select s.ix, s.iy, s.iz, g.cls, t0, length, lad from seg s join g on s.ix=g.ix and s.iy=g.iy and s.iz=g.iz where {one} and g.cls in (3,4,5) order by t0 limit 20) x",
    )
    return {k: (f, duck(sql)) for k, (f, sql) in q.items()}
