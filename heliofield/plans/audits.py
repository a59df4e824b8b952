"""Queries of audits, scene rays and older variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliofield.operators import audit as A
from heliofield.operators import geometry as G
from heliofield.operators import matrix as M
from heliofield.operators import points as P
from heliofield.operators import rays as R
from heliofield.operators import sun as SUN
from heliofield.plans import light
from heliofield.plans.cloud import r6
from heliofield.plans.power import days, inv, smooth_sql, sun_sql, views
from heliofield.plans.proxies import INV, MATRIX, VIEWS, duck, matrix

CELL = "greatest(0, least(90, cast(round_even(altitude, 0) as int))) as r_, greatest(0, least(360, cast(round_even(azimuth, 0) as int))) as c_"
V = f"v0 as ({VIEWS}), v as (select t, max(v) as v from v0 group by t), {sun_sql('v', 't', 'p')}"


def sun_at(s, d):
    return SUN.sun_position(views(s, d).groupBy("t").agg(F.max("v").alias("v")), "t")


def probes(s, d):
    return days(s, d).select((F.col("day").cast("timestamp_ntz") + F.expr("interval '10' hour")).alias("probe"))


def landmark_sql(name, src, value):
    return f"select '{name}' as stage, day, min(case when rn = 1 then t end) as peak_at, min(case when {value} > 100 then t end) as above_at, avg(case when hour(t) = 0 then {value} end) as mean_0h, avg(case when hour(t) = 12 then {value} end) as mean_12h from (select *, cast(t as date) as day, row_number() over (partition by cast(t as date) order by {value} desc, t) as rn from {src}) x group by day"


def path_curve(s, d):
    """Altitudes along reference sun paths interpolated at whole azimuths, two degrees up."""
    paths = SUN.sun_paths(s, sun_at(s, d).select(F.to_date("t").alias("day"))).select("day", "azimuth", "altitude")
    at = paths.select("day").distinct().withColumn("azimuth", F.explode(F.sequence(F.lit(100), F.lit(260), F.lit(20)))).withColumn("azimuth", F.col("azimuth").cast("double"))
    return SUN.interpolate(paths, "azimuth", "altitude", at, "day").select("day", "azimuth", F.round(F.col("altitude") + 2.0, 6).alias("label_altitude"))


def capped(s, d):
    """The older sweep stops at 55 degrees; cells above stay null."""
    sweep = R.sky_sweep(light.per_ray(s, d)).where("alt <= 55 and az < 360")
    return M.completed(sweep.select(F.col("alt").cast("int").alias("alt"), F.col("az").cast("int").alias("az"), "shadow")).where("alt % 10 = 5 and az % 30 = 0").select("alt", "az", *r6("shadow"))


def capped_whole(s, d):
    """The same at every degree; cells above 55 degrees stay null."""
    sweep = light.sweep_whole(s, d, top=55.0).where("az < 360")
    return M.completed(sweep.select(F.col("alt").cast("int").alias("alt"), F.col("az").cast("int").alias("az"), "shadow")).select("alt", "az", *r6("shadow"))


def queries():
    q = {"sky_sweep_capped_whole": (capped_whole, "")}
    q["chain_audit"] = (
        lambda s, d: A.chain_audit({"logger": (inv(s, d), "e"), "forecast": (views(s, d), "v")}).select("stage", "day", "peak_at", "above_at", *r6("mean_0h", "mean_12h")),
        f"with i0 as ({INV}), v0 as ({VIEWS}), u as ({landmark_sql('logger', 'i0', 'e')} union all {landmark_sql('forecast', 'v0', 'v')}) select stage, day, peak_at, above_at, round(mean_0h,6) as mean_0h, round(mean_12h,6) as mean_12h from u",
    )
    sm = smooth_sql(2, 2).replace("with m as", "m as").replace(" select alt, az, round(greatest(0.0D, least(1.0D, shadow)), 6) as shadow from b", ", sm as (select alt, az, greatest(0.0D, least(1.0D, shadow)) as shadow from b)")
    q["shadow_audit"] = (
        lambda s, d: A.shadow_audit(sun_at(s, d), probes(s, d), matrix(s, d), M.smooth(matrix(s, d))).select("probe", "nearest", "row", "col", *r6("altitude", "azimuth", "raw_shadow", "smoothed_shadow")),
        f"""with {V}, {sm}, i0 as ({INV}), pr as (select distinct cast(cast(t as date) as timestamp) + interval '10 hours' as probe from i0),
n as (select probe, p.*, row_number() over (partition by probe order by abs(floor(epoch(t))::bigint - epoch(probe)::bigint), floor(epoch(t)), t) as rn from pr join p on abs(floor(epoch(t))::bigint - epoch(probe)::bigint) <= 14400), o as (select *, {CELL} from n where rn = 1)
select probe, t as nearest, r_ as "row", c_ as col, round(altitude,6) as altitude, round(azimuth,6) as azimuth, round(case when altitude > 0.5D then m.shadow else 0 end,6) as raw_shadow, round(case when altitude > 0.5D then sm.shadow else 0 end,6) as smoothed_shadow from o join m on m.alt = r_ and m.az = c_ join sm on sm.alt = r_ and sm.az = c_""",
    )
    q["altitude_profile"] = (lambda s, d: A.altitude_profile(matrix(s, d), 170).select("alt", *r6("shadow")), f"with m as ({MATRIX}) select alt, round(shadow,6) as shadow from m where az = 170")
    q["facade_shadows"] = (
        lambda s, d: A.facade_shadows(sun_at(s, d), matrix(s, d), 170.0).select("t", *r6("altitude", "azimuth", "beam_shadow")),
        f"with {V}, m as ({MATRIX}), o as (select *, {CELL} from p where altitude > 0.5D and abs((azimuth-170.0D+180.0D) - 360.0D*floor((azimuth-170.0D+180.0D)/360.0D) - 180.0D) <= 30) select t, round(altitude,6) as altitude, round(azimuth,6) as azimuth, round(shadow,6) as beam_shadow from o join m on alt = r_ and az = c_ where shadow > 0.3D",
    )
    q["projection_rays"] = (
        lambda s, d: A.scene_rays(G.panel_points(s, G.BANK1), sun_at(s, d).where("hour(t) = 11").select("t", "altitude", "azimuth"), matrix(s, d)).select("t", "panel", *r6("transmittance", "end_x", "end_y", "end_z")),
        f"""with {V}, m as ({MATRIX}), {light.panels_sql(G.BANK1, 'pa', None)}, o as (select *, {CELL} from p where hour(t) = 11)
select t, panel, round(case when altitude > 0.5D then 1 - shadow else 1 end,6) as transmittance, round(pa.x + 50.0D*(cos(radians(altitude))*sin(radians(azimuth))),6) as end_x, round(pa.y + 50.0D*(cos(radians(altitude))*cos(radians(azimuth))),6) as end_y, round(pa.z + 50.0D*sin(radians(altitude)),6) as end_z from o join m on alt = r_ and az = c_, pa""",
    )
    q["sun_path_labels"] = (
        path_curve,
        f"""with v as ({VIEWS}), d0 as (select distinct cast(t as date) as day from v), ms as (select day, unnest(generate_series(cast(day as timestamp), cast(day as timestamp) + interval '1430 minutes', interval '10 minutes')) as ts from d0), {sun_sql('ms', 'ts', 'p')},
c as (select day, azimuth as x0, altitude as y0, lead(azimuth) over (partition by day order by azimuth) as x1, lead(altitude) over (partition by day order by azimuth) as y1 from p where elevation > 0), a as (select day, cast(unnest(range(100, 261, 20)) as double) as azimuth from d0)
select a.day, a.azimuth, round(coalesce(min(y0 + (azimuth-x0)/(x1-x0)*(y1-y0)), 0) + 2.0D, 6) as label_altitude from a left join c on c.day = a.day and azimuth >= x0 and azimuth <= x1 group by a.day, a.azimuth""",
    )
    q["panel_points_legacy"] = (
        lambda s, d: G.panel_points(s, G.BANK1, P.roof_height(light.pts(s, d), 30.0, 27.0), centred=True).select("panel", *r6("x", "y", "z")),
        f"{light.W}, {light.ROOF}, {light.panels_sql(G.BANK1, 'pa', None)}, l as (select panel, -n*0.5D + pos as lx, ((n_rows-1-row)*1.6D - (n_rows-1)*0.8D) as yy, cx, cy, cz, tilt, azimuth from (select *, first + pos as panel from pa_l) x), t as (select *, yy*cos(radians(tilt)) as ly, yy*sin(radians(tilt)) as lz from l) select cast(panel as int) as panel, round(lx*cos(radians(180.0D-azimuth)) - ly*sin(radians(180.0D-azimuth)) + cx,6) as x, round(lx*sin(radians(180.0D-azimuth)) + ly*cos(radians(180.0D-azimuth)) + cy,6) as y, round(lz + cz + (select anchor_z from roof),6) as z from t",
    )
    q["sky_sweep_capped"] = (
        capped,
        f"{light.LIGHT}, {light.HIT}, {light.SWEEP}, g2 as (select a.alt, z.az from (select cast(unnest(range(5, 91, 10)) as int) as alt) a cross join (select cast(unnest(range(0, 361, 30)) as int) as az) z) select g2.alt, g2.az, round(sw.shadow, 6) as shadow from g2 left join sw on cast(sw.alt as int) = g2.alt and cast(sw.az as int) = g2.az and g2.alt <= 55 and g2.az < 360",
    )
    q["building_candidates"] = (lambda s, d: P.candidates(P.class_filter(light.pts(s, d), (1, 5)).withColumn("hag", F.col("z") - 100.0)).select("pid", "cls"), f"{light.W} select pid, cls from pts where cls in (1, 5) and z - 100.0D between 2 and 50")
    return {k: (f, duck(sql)) for k, (f, sql) in q.items()}
