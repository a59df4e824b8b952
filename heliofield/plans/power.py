"""Queries on matrices, weather, inverter logs, power and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliofield.operators import evaluation as E
from heliofield.operators import matrix as M
from heliofield.operators import pv as PV
from heliofield.operators import series as S
from heliofield.operators import stats as ST
from heliofield.operators import sun as SUN
from heliofield.plans.cloud import r6
from heliofield.plans.proxies import CAMS, INV, MATRIX, PAIRS, RAD, TEMP, VIEWS, duck, frame, matrix

FIXED = "2024-01-15"
METRICS = ["rmse_base", "mae_base", "mbe_base", "r2_base", "rmse_shaded", "mae_shaded", "mbe_shaded", "r2_shaded", "real_wh", "base_wh", "shaded_wh"]


def inv(s, d):
    return frame(s, d, INV)


def pairs(s, d):
    return frame(s, d, PAIRS)


def days(s, d):
    return inv(s, d).groupBy(F.to_date("t").alias("day")).agg(F.count("*").alias("n"))


def views(s, d):
    return frame(s, d, VIEWS)


def forecast(s, d):
    """A forecast on the view events' times: irradiance from their values, positions from the sun."""
    base = views(s, d).select("t", "event_id", (F.col("v") * 2.0).alias("dni"), F.col("v").alias("dhi"), (F.col("v") * 3.0).alias("ghi"), (F.col("v") * 4.0).alias("output"))
    return SUN.sun_position(base, "t")


def metrics(s, d):
    return PV.day_metrics(pairs(s, d))


def sun_sql(src: str, ts: str, out: str) -> str:
    lat, lon = SUN.SITE
    return f"""{out}_t as (select *, (epoch_us({ts})/1e6/86400.0D + 2440587.5D - 2451545.0D)/36525.0D as jc, epoch_us({ts})/1e6 as sec from {src}),
{out}_a as (select *, (280.46646D + jc*(36000.76983D + 0.0003032D*jc)) as l_, 357.52911D + jc*(35999.05029D - 0.0001537D*jc) as m_, 0.016708634D - jc*(0.000042037D + 0.0000001267D*jc) as ec, 125.04D - 1934.136D*jc as om from {out}_t),
{out}_b as (select *, l_ - 360.0D*floor(l_/360.0D) as l0 from {out}_a),
{out}_c as (select *, l0 + sin(radians(m_))*(1.914602D - jc*(0.004817D + 0.000014D*jc)) + sin(radians(2*m_))*(0.019993D - 0.000101D*jc) + sin(radians(3*m_))*0.000289D - 0.00569D - 0.00478D*sin(radians(om)) as ap,
  23 + (26 + (21.448D - jc*(46.815D + jc*(0.00059D - 0.001813D*jc)))/60)/60 + 0.00256D*cos(radians(om)) as ti from {out}_b),
{out}_d as (select *, asin(sin(radians(ti))*sin(radians(ap))) as de, tan(radians(ti/2))*tan(radians(ti/2)) as y_ from {out}_c),
{out}_e as (select *, 4*degrees(y_*sin(radians(2*l0)) - 2*ec*sin(radians(m_)) + 4*ec*y_*sin(radians(m_))*cos(radians(2*l0)) - 0.5D*y_*y_*sin(radians(4*l0)) - 1.25D*ec*ec*sin(radians(2*m_))) as eq from {out}_d),
{out}_f as (select *, (sec - 86400.0D*floor(sec/86400.0D))/60 + eq + 4*{lon}D as so from {out}_e),
{out}_g as (select *, radians((so - 1440.0D*floor(so/1440.0D))/4 - 180) as ha from {out}_f),
{out}_h as (select *, degrees(asin(greatest(-1.0D, least(1.0D, sin(radians({lat}D))*sin(de) + cos(radians({lat}D))*cos(de)*cos(ha))))) as elevation, degrees(atan2(sin(ha), cos(ha)*sin(radians({lat}D)) - tan(de)*cos(radians({lat}D)))) + 180 as aw from {out}_g),
{out} as (select *, aw - 360.0D*floor(aw/360.0D) as azimuth, elevation + case when elevation >= -0.83337D then (1013.25D/1010.0D)*(283.0D/285.0D)*1.02D/(60*tan(radians(elevation + 10.3D/(elevation + 5.11D)))) else 0.0D end as altitude from {out}_h)"""


def smooth_sql(n_az: int, n_alt: int) -> str:
    def one(src, out, along, other, n, top):
        low, high = -(n // 2), n - 1 - n // 2
        return f"{out} as (select b.alt, b.az, avg(s.shadow) as shadow from {src} b cross join (select unnest(range({low}, {high + 1})) as o) o join {src} s on s.{other} = b.{other} and s.{along} = greatest(0, least({top}, b.{along} + o.o)) group by b.alt, b.az)"

    return f"with m as ({MATRIX}), {one('m', 'a', 'alt', 'az', n_alt, 90)}, {one('a', 'b', 'az', 'alt', n_az, 360)} select alt, az, round(greatest(0.0D, least(1.0D, shadow)), 6) as shadow from b"


HEMI = "select case when sum(w) <> 0 then sum(shadow*w)/sum(w) else 0 end as factor from (select shadow, cos(radians(90.0D-(alt+1)))*sin(radians(90.0D-(alt+1))) as w from m) h"
PROJ = "greatest(0, least(90, cast(round_even(altitude, 0) as int))) as r_, greatest(0, least(360, cast(round_even(azimuth, 0) as int))) as c_"
FC = f"m as ({MATRIX}), v as ({VIEWS}), f0 as (select t, event_id, v*2.0D as dni, v as dhi, v*3.0D as ghi, v*4.0D as output from v), {sun_sql('f0', 't', 'f1')}, f2 as (select f1.*, {PROJ} from f1), fc as (select f2.*, case when altitude > 0.5D then greatest(0.0D, least(1.0D, shadow)) else 0 end as sb, ({HEMI}) as sd from f2 join m on m.alt = r_ and m.az = c_)"
DAYM = f"""p0 as ({PAIRS}), p1 as (select *, real > 10 or base > 10 as up from p0), p2 as (select *, avg(case when up then real end) over (partition by day) as mean_ from p1),
dm as (select day, count(*) filter (where up) as n_daytime, {", ".join(f"sqrt(avg(case when up then ({k}-real)*({k}-real) end)) as rmse_{k}, avg(case when up then abs({k}-real) end) as mae_{k}, avg(case when up then {k}-real end) as mbe_{k}, case when count(*) filter (where up) > 2 and sum(case when up then (real-mean_)*(real-mean_) end) > 0 then 1 - sum(case when up then ({k}-real)*({k}-real) end)/sum(case when up then (real-mean_)*(real-mean_) end) end as r2_{k}" for k in ("base", "shaded"))},
  {", ".join(f"sum({k})*5.0D/60.0D as {k}_wh" for k in ("real", "base", "shaded"))} from p2 group by day)"""


def chg(new, old):
    return f"case when {old} = 0 then 0.0D else ({new}-{old})/{old}*100 end"


INV_SQL = f"i0 as ({INV}), i1 as (select *, lag(t) over (order by t, event_id) as prev_t from i0), i2 as (select *, epoch_us(t - prev_t)/60e6 as dt_min from i1)"
DST = "case when d_ > last_day(make_date(year(d_), 3, 1)) - cast((dayofweek(last_day(make_date(year(d_), 3, 1)))) as int) and d_ <= last_day(make_date(year(d_), 10, 1)) - cast((dayofweek(last_day(make_date(year(d_), 10, 1)))) as int) then 3 else 2 end"
BIN = "time_bucket(interval '5 minutes', t)"
WX = f"""tw as ({TEMP}), ra as ({RAD}), fj as (select coalesce(tw.t, ra.t) as t, temp, wind, ghi, dhi from tw full join ra on tw.t = ra.t)"""
BINS = f"""bi as (select {BIN} as t, avg(temp) as temp, avg(wind) as wind, avg(ghi) as ghi, avg(dhi) as dhi from fj group by 1), sp as (select unnest(generate_series(a, b, interval '5 minutes')) as t from (select min(t) as a, max(t) as b from bi) r), re as (select sp.t, temp, wind, ghi, dhi from sp left join bi on sp.t = bi.t)"""
R3 = ["temp", "ghi", "dhi"]


def round_sql(names):
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


def full(s, d):
    return S.full_join([frame(s, d, TEMP), frame(s, d, RAD)], "t")


def day_spine(s, d):
    own = inv(s, d).groupBy(F.to_date("t").alias("day"), F.window("t", "5 minutes")["start"].alias("t")).agg(F.avg("e").alias("power"))
    return S.day_grid(own, "day", "t", ["power"])


def tz_shift(s, d):
    return S.logger_to_local(inv(s, d).withColumn("day", F.to_date("t")), "t", "day").select("event_id", "day", "t")


def cams(s, d):
    return frame(s, d, CAMS).groupBy("t").agg(*(F.max(c).alias(c) for c in ("dni", "ghi", "dhi")))


def weather(s, d):
    return PV.weather_day(frame(s, d, TEMP), frame(s, d, RAD), cams(s, d))


def log(s, d):
    return S.inverter_power(inv(s, d)).select("t", "power_w")


def matched(s, d):
    """Measured, base and shaded of each day with weather on the five-minute grid, in civil time."""
    return E.matched_days(E.measured_days(log(s, d)), E.forecast_days(weather(s, d), matrix(s, d), shift_minutes=-30.0))


#: Two sub-arrays of one logger (fixed values of the studied site: 8 and 6 of 14 panels).
NORTH, SOUTH = (PV.Site(nominal_w=w, tilt=20.0, azimuth=260.0, efficiency=0.85) for w in (2640.0, 1980.0))


def turned(m):
    """The proxy matrix of the second sub-array: the first one's, half as dark."""
    return m.withColumn("shadow", F.col("shadow") * 0.5)


def evaluated(s, d, arrays=None):
    """Pairs and metrics of the days that have a log, with the weather loaded for them."""
    m = matrix(s, d)
    listed = inv(s, d).select(F.to_date("t").alias("day")).distinct()
    return E.evaluate_days(listed, log(s, d), lambda days: weather(s, d).join(days, "day", "left_semi").drop("day"), arrays or [(NORTH, m), (SOUTH, turned(m))], -30.0)


def two_banks(s, d):
    base = forecast(s, d).groupBy("t").agg(F.avg("output").alias("output"))
    return PV.bank_sum([base.select("t", (F.col("output") * 8 / 14).alias("output")), base.where(F.minute("t") % 2 == 0).select("t", (F.col("output") * 6 / 14).alias("output"))], "t", ["output"])


def power_model(s, d):
    w = forecast(s, d).drop("output").withColumn("temp", F.col("dhi") / 50.0).withColumn("wind", F.lit(2.0)).withColumn("albedo", F.lit(0.2))
    return PV.baseline_power(w).select("event_id", *r6("plane", "output"))


def probes(s, d):
    p = days(s, d).select((F.col("day").cast("timestamp_ntz") + F.expr("interval '12' hour")).alias("probe"))
    series = views(s, d).groupBy("t").agg(F.max("v").alias("v"))
    return S.nearest_in_time(series, p, "t", ["v"], 240, rounded=True)


def gain(s, d):
    return PV.energy_error(metrics(s, d)).orderBy("error_gain", "day")


def sun_fraction(s, d):
    """Fractions and shadow factors at the forecast's times."""
    return PV.apply_shadows(forecast(s, d), matrix(s, d)).select("event_id", *r6("altitude", "azimuth", "shadow_beam", "shadow_diffuse", "beam_fraction", "diffuse_fraction", "output_shaded"))


WEATHER = f"""{WX}, {BINS}, c as (select t, max(dni) as dni, max(ghi) as cg, max(dhi) as cd from ({CAMS}) x group by t), dy as (select cast(t as date) as day, avg(temp) as m from re group by 1),
wd as (select dy.day, re.t, c.dni, coalesce(re.dhi, c.cd) as dhi, coalesce(re.ghi, c.cg) as ghi, re.temp, re.wind, case when m is null then 0.2D else round(0.65D/(1+exp((m-1)/0.75D)) + 0.2D*(1-1/(1+exp((m-1)/0.75D))), 3) end as albedo
  from re asof left join c on re.t >= c.t join dy on cast(re.t as date) = dy.day)"""
D_SUN = "last_day(make_date(year({1}), {0}, 1)) - cast(dayofweek(last_day(make_date(year({1}), {0}, 1))) as int)"
OFFSET = f"case when day > {D_SUN.format(3, 'day')} and day <= {D_SUN.format(10, 'day')} then 3 else 2 end"


def array_sql(k: int, site: PV.Site, dark: str) -> str:
    """a<k>: (day, t, base, shaded) of one sub-array, from the weather wd with the sun's position in wp."""
    tilt, az = f"radians({site.tilt}D)", f"radians({site.azimuth}D)"
    return f"""m{k} as (select alt, az, shadow*{dark} as shadow from ({MATRIX}) x), h{k} as (select case when sum(w) <> 0 then sum(shadow*w)/sum(w) else 0 end as sd from (select shadow, cos(radians(90.0D-(alt+1)))*sin(radians(90.0D-(alt+1))) as w from m{k}) h),
g{k} as (select *, greatest(case when altitude > 0 then coalesce(dni, 0)*greatest(sin(radians(altitude))*cos({tilt}) + cos(radians(altitude))*sin({tilt})*cos(radians(azimuth)-{az}), 0.0D) else 0 end
  + coalesce(dhi, 0)*((1+cos({tilt}))/2) + coalesce(ghi, 0)*albedo*((1-cos({tilt}))/2), 0.0D) as plane from wp),
o{k} as (select *, greatest(plane/1000.0D*{site.nominal_w}D*(1-0.004D*(coalesce(temp, 20.0D) + plane*(25.0D/800.0D)*9.5D/(5.7D+3.8D*coalesce(wind, 2.0D)) - 25.0D)), 0.0D) as output,
  case when dni is null or ghi is null then 0.0D else least(1.0D, greatest(0.0D, dni*greatest(cos(radians(90.0D-altitude)), 0.0D)/greatest(ghi, 1e-6))) end as b,
  case when dhi is null or ghi is null then 0.0D else least(1.0D, greatest(0.0D, dhi/greatest(ghi, 1e-6))) end as d from g{k}),
s{k} as (select o{k}.*, sd, case when altitude > 0.5D then greatest(0.0D, least(1.0D, shadow)) else 0 end as sb from o{k} cross join h{k} join m{k} on m{k}.alt = r_ and m{k}.az = c_),
b{k} as (select day, time_bucket(interval '5 minutes', t - interval '30 minutes' + to_hours({OFFSET})) as t, avg(output*{site.efficiency}D) as base, avg(output*greatest(0.0D, least(1.0D, b*(1-sb) + d*(1-sd) + greatest(0.0D, least(1.0D, 1-b-d))*(1-sd)))*{site.efficiency}D) as shaded from s{k} group by 1, 2),
a{k} as (select sp.day, sp.t, case when b{k}.t is null then 0 else base end as base, case when b{k}.t is null then 0 else shaded end as shaded from spine sp left join b{k} on sp.day = b{k}.day and sp.t = b{k}.t)"""


def evaluation_sql(arrays: list[tuple[PV.Site, str]], days: str) -> str:
    """pr: (day, t, real, base, shaded), from the inverter log and the weather of the days in the given condition."""
    real = f"""{INV_SQL}, ik as (select median(dt_min) as md, max(e)*(60.0D/5.0D)*2 as cap from i2), iw as (select t, cast(t as date) as day, case when e is null then 0 when coalesce(dt_min, md) = 0 then case when e > 0 then cap else 0 end else least(e/(coalesce(dt_min, md)/60.0D), cap) end as power_w from i2, ik),
lb as (select day, time_bucket(interval '5 minutes', t + to_hours({OFFSET} - 3)) as t, avg(power_w) as real from iw group by 1, 2)"""
    sums = ", ".join("+".join(f"a{k}.{c}" for k in range(len(arrays))) + f" as {c}" for c in ("base", "shaded"))
    met = "".join(f" join a{k} on a0.day = a{k}.day and a0.t = a{k}.t" for k in range(1, len(arrays)))
    return f"""{WEATHER}, {real}, wk as (select * from wd where {days}), {sun_sql('wk', 't', 'w0')}, wp as (select w0.*, {PROJ} from w0),
spine as (select day, unnest(generate_series(cast(day as timestamp), cast(day as timestamp) + interval '1435 minutes', interval '5 minutes')) as t from (select distinct day from wk) x),
{", ".join(array_sql(k, site, dark) for k, (site, dark) in enumerate(arrays))},
fc as (select a0.day, a0.t, {sums} from a0{met}), pr as (select fc.day, fc.t, coalesce(lb.real, 0) as real, coalesce(base, 0) as base, coalesce(shaded, 0) as shaded from fc left join lb on fc.day = lb.day and fc.t = lb.t)"""


BANKS = [(NORTH, "1.0D"), (SOUTH, "0.5D")]
LOGGED = "day in (select cast(t as date) from i0)"


def queries():
    q = {}
    q["matrix_smooth_2x2"] = (lambda s, d: M.smooth(matrix(s, d), 2, 2).select("alt", "az", *r6("shadow")), smooth_sql(2, 2))
    q["matrix_smooth_3x3"] = (lambda s, d: M.smooth(matrix(s, d), 3, 3).select("alt", "az", *r6("shadow")), smooth_sql(3, 3))
    q["matrix_round_trip"] = (lambda s, d: M.from_wide(M.to_wide(matrix(s, d))).select("alt", "az", *r6("shadow")), f"select alt, az, round(shadow, 6) as shadow from ({MATRIX}) m")
    q["shadow_pivot"] = (lambda s, d: M.to_wide(matrix(s, d), range(0, 361, 90)).select("label", *r6(*(f"Azimuth_{a}" for a in range(0, 361, 90)))), f"with m as ({MATRIX}) select 'Altitude_' || alt as label, {', '.join(f'round(max(case when az = {a} then shadow end), 6) as Azimuth_{a}' for a in range(0, 361, 90))} from m group by alt")
    q["matrix_completed"] = (lambda s, d: M.completed(matrix(s, d).where("alt <= 55")).select("alt", "az", *r6("shadow")), f"with m as ({MATRIX}) select alt, az, case when alt <= 55 then round(shadow, 6) end as shadow from m")
    q["hemisphere_factor"] = (lambda s, d: M.hemisphere_factor(matrix(s, d)).select(*r6("factor")), f"with m as ({MATRIX}) select round(factor, 6) as factor from ({HEMI}) x")
    q["matrix_stats"] = (lambda s, d: M.stats(matrix(s, d)).select(*r6("low", "high", "mean")), f"with m as ({MATRIX}) select round(min(shadow),6) as low, round(max(shadow),6) as high, round(avg(shadow),6) as mean from m")
    q["matrix_azimuth_sweep"] = (lambda s, d: M.azimuth_sweep(matrix(s, d), 20).select("az", *r6("shadow")), f"with m as ({MATRIX}) select az, round(shadow,6) as shadow from m where alt = 20")
    q["sun_position"] = (lambda s, d: SUN.sun_position(views(s, d), "t").select("event_id", *r6("elevation", "altitude", "azimuth")), f"with v as ({VIEWS}), {sun_sql('v', 't', 'p')} select event_id, {round_sql(['elevation', 'altitude', 'azimuth'])} from p")
    mins = "dy as (select distinct cast(t as date) as day from v), ms as (select day, unnest(generate_series(cast(day as timestamp), cast(day as timestamp) + interval '1439 minutes', interval '1 minute')) as ts from dy)"
    q["sunrise_per_day"] = (lambda s, d: SUN.sunrise_per_day(views(s, d).select(F.to_date("t").alias("day")).distinct()), f"with v as ({VIEWS}), {mins}, {sun_sql('ms', 'ts', 'p')} select day, min(ts) as sunrise from p where elevation > 0 group by day")
    q["sun_path"] = (
        lambda s, d: SUN.sun_paths(s, views(s, d).select(F.to_date("t").alias("day"))).select("day", "ts", *r6("altitude", "azimuth")),
        f"with v as ({VIEWS}), d0 as (select distinct cast(t as date) as day from v), ms as (select day, unnest(generate_series(cast(day as timestamp), cast(day as timestamp) + interval '1430 minutes', interval '10 minutes')) as ts from d0), {sun_sql('ms', 'ts', 'p')} select day, ts, round(altitude,6) as altitude, round(azimuth,6) as azimuth from p where elevation > 0",
    )
    q["shadow_lookup"] = (lambda s, d: M.lookup(forecast(s, d), matrix(s, d)).select("event_id", *r6("beam_shadow")), f"with {FC} select event_id, round(sb, 6) as beam_shadow from fc")
    q["shadow_lookup_legacy"] = (
        lambda s, d: M.lookup(forecast(s, d), matrix(s, d), legacy=True).select("event_id", *r6("beam_shadow")),
        f"with m as ({MATRIX}), v as ({VIEWS}), {sun_sql('v', 't', 'p')}, l as (select p.*, greatest(0, least(90, cast(round_even(greatest(altitude, 1) - 1, 0) as int))) as r_, greatest(0, least(360, cast(round_even(azimuth, 0) as int))) as c_ from p) select event_id, round(case when altitude > 0.5D then shadow else 0 end, 6) as beam_shadow from l join m on alt = r_ and az = c_",
    )
    frac = "case when altitude is null then 0 else least(1.0D, greatest(0.0D, dni*greatest(cos(radians(90.0D-altitude)), 0.0D)/greatest(ghi, 1e-6))) end as b, least(1.0D, greatest(0.0D, dhi/greatest(ghi, 1e-6))) as d"
    shaded = "output*greatest(0.0D, least(1.0D, b*(1-sb) + d*(1-sd) + greatest(0.0D, least(1.0D, 1-b-d))*(1-sd)))"
    q["apply_shadows_beam_diffuse"] = (sun_fraction, f"with {FC}, g as (select *, {frac} from fc) select event_id, {round_sql(['altitude', 'azimuth'])}, round(sb,6) as shadow_beam, round(sd,6) as shadow_diffuse, round(b,6) as beam_fraction, round(d,6) as diffuse_fraction, round({shaded},6) as output_shaded from g")
    q["apply_shadows_beam_only"] = (lambda s, d: PV.apply_shadows(forecast(s, d), matrix(s, d), beam_only=True).select("event_id", *r6("output_shaded")), f"with {FC} select event_id, round(output*(1-sb), 6) as output_shaded from fc")
    q["baseline_power"] = (
        power_model,
        f"""with v as ({VIEWS}), f0 as (select t, event_id, v*2.0D as dni, v as dhi, v*3.0D as ghi from v), {sun_sql('f0', 't', 'p')},
g as (select event_id, dhi, greatest(case when altitude > 0 then dni*greatest(sin(radians(altitude))*cos(radians(12.0D)) + cos(radians(altitude))*sin(radians(12.0D))*cos(radians(azimuth)-radians(170.0D)), 0.0D) else 0 end + dhi*((1+cos(radians(12.0D)))/2) + ghi*0.2D*((1-cos(radians(12.0D)))/2), 0.0D) as plane from p)
select event_id, round(plane,6) as plane, round(greatest(plane/1000.0D*3960.0D*(1-0.004D*(dhi/50.0D + plane*(25.0D/800.0D)*9.5D/(5.7D+3.8D*2.0D) - 25.0D)), 0.0D), 6) as output from g""",
    )
    dcnt = f"i0 as ({INV}), dc as (select cast(t as date) as day, count(*) as n from i0 group by 1)"
    q["clear_days"] = (lambda s, d: PV.clear_days(days(s, d)), f"with {dcnt}, q as (select quantile_cont(n, 0.25) as a, quantile_cont(n, 0.75) as b from dc) select day, n from dc, q where n > b + 0.8D*(b-a)")
    q["exclude_days"] = (lambda s, d: PV.exclude_days(days(s, d), ["2024-01-05", "2024-01-09"]), f"with {dcnt} select day, n from dc where day not in (date '2024-01-05', date '2024-01-09')")
    q["days_with_weather"] = (lambda s, d: PV.clear_days(days(s, d), 0.0).join(frame(s, d, TEMP).select(F.to_date("t").alias("day")), "day", "left_semi"), f"with {dcnt}, q as (select quantile_cont(n, 0.25) as a, quantile_cont(n, 0.75) as b from dc), tw as ({TEMP}) select day, n from dc, q where n > b and day in (select cast(t as date) from tw)")
    q["ranked_days"] = (lambda s, d: PV.ranked_days(days(s, d), 5), f"with {dcnt} select day, n, cast(row_number() over (order by n desc, day) as int) as rank from dc order by n desc, day limit 5")
    q["albedo_sigmoid"] = (
        lambda s, d: frame(s, d, TEMP).groupBy(F.to_date("t").alias("day")).agg(F.avg("temp").alias("m")).select("day", PV.albedo(F.col("m")).alias("albedo"), PV.albedo_legacy(F.col("m")).alias("legacy")),
        f"with tw as ({TEMP}), m as (select cast(t as date) as day, avg(temp) as m from tw group by 1) select day, round(0.65D/(1+exp((m-1)/0.75D)) + 0.2D*(1-1/(1+exp((m-1)/0.75D))), 3) as albedo, case when m < 0 then 0.7D else 0.2D end as legacy from m",
    )
    q["weather_full_join"] = (lambda s, d: full(s, d).select("t", *r6(*R3)), f"with {WX} select t, {round_sql(R3)} from fj")
    q["resample_5min"] = (lambda s, d: S.resample(full(s, d), "t", R3).select("t", *r6(*R3)), f"with {WX}, {BINS} select t, {round_sql(R3)} from re")
    q["asof_fill"] = (
        lambda s, d: S.asof_backward(views(s, d), frame(s, d, CAMS), "t", tie=["event_id"]).select("event_id", F.col("match.event_id").alias("from_id"), F.round("match.dni", 6).alias("dni")),
        f"with v as ({VIEWS}), c as (select *, row_number() over (partition by t order by event_id desc) as rn from ({CAMS}) x) select v.event_id, c.event_id as from_id, round(c.dni, 6) as dni from v asof left join (select * from c where rn = 1) c on v.t >= c.t",
    )
    q["weather_assembly"] = (lambda s, d: weather(s, d).select("day", "t", *r6("dni", "dhi", "ghi", "temp", "wind", "albedo")), f"with {WEATHER} select day, t, {round_sql(['dni', 'dhi', 'ghi', 'temp', 'wind', 'albedo'])} from wd")
    q["inverter_power"] = (
        lambda s, d: S.inverter_power(inv(s, d)).select("event_id", "t", *r6("dt_min", "power_w")),
        f"with {INV_SQL}, k as (select median(dt_min) as md, max(e)*(60.0D/5.0D)*2 as cap from i2) select event_id, t, round(dt_min,6) as dt_min, round(case when e is null then 0 when coalesce(dt_min, md) = 0 then case when e > 0 then cap else 0 end else least(e/(coalesce(dt_min, md)/60.0D), cap) end, 6) as power_w from i2, k",
    )
    q["inverter_gap_stats"] = (lambda s, d: S.interval_stats(inv(s, d)).select(*r6("median_min"), "n_normal", "n_gaps", "n_total"), f"with {INV_SQL} select round(median(dt_min),6) as median_min, count(*) filter (where abs(dt_min-5) < 1) as n_normal, count(*) filter (where dt_min > 6) as n_gaps, count(dt_min) as n_total from i2")
    grid5 = f"b as (select cast(t as date) as day, {BIN} as t, avg(e) as power from i0 group by 1, 2), sp as (select day, unnest(generate_series(cast(day as timestamp), cast(day as timestamp) + interval '1435 minutes', interval '5 minutes')) as t from (select distinct day from b) x)"
    q["day_spine_fill"] = (lambda s, d: day_spine(s, d).select("day", "t", *r6("power")), f"with i0 as ({INV}), {grid5} select sp.day, sp.t, round(case when b.t is null then 0 else power end, 6) as power from sp left join b on sp.day=b.day and sp.t=b.t")
    sun = "last_day(make_date(year(d_), {0}, 1)) - cast(dayofweek(last_day(make_date(year(d_), {0}, 1))) as int)"
    off = f"case when d_ > {sun.format(3)} and d_ <= {sun.format(10)} then 3 else 2 end"
    q["tz_shift_local"] = (tz_shift, f"with i0 as ({INV}), s as (select event_id, t, cast(t as date) as d_ from i0) select event_id, d_ as day, t + to_hours({off} - 3) as t from s")
    q["forecast_shift"] = (lambda s, d: S.shift_on_grid(S.utc_to_local(views(s, d).withColumn("day", F.to_date("t")), "t", "day"), "t", -30.0).select("event_id", "t"), f"with v as ({VIEWS}), s as (select event_id, t, cast(t as date) as d_ from v) select event_id, t + to_hours({off}) - interval '30 minutes' as t from s")
    power3 = ["real", "base", "shaded"]
    q["day_pipeline"] = (lambda s, d: matched(s, d).select("day", "t", *r6(*power3)), f"with {evaluation_sql([(PV.Site(), '1.0D')], 'true')} select day, t, {round_sql(power3)} from pr")
    q["bank_day_pipeline"] = (lambda s, d: evaluated(s, d)[0].select("day", "t", *r6(*power3)), f"with {evaluation_sql(BANKS, LOGGED)} select day, t, {round_sql(power3)} from pr")
    q["evaluate_days"] = (
        lambda s, d: evaluated(s, d)[1].select("day", "n_daytime", *(F.round(c, 4).alias(c) for c in METRICS)),
        f"with {evaluation_sql(BANKS, LOGGED)}, {DAYM.replace(PAIRS, 'select day, real, base, shaded from pr')} select day, n_daytime, {', '.join(f'round({c}, 4) as {c}' for c in METRICS)} from dm",
    )
    q["carry_irradiance"] = (
        lambda s, d: E.carry_irradiance(views(s, d).groupBy("t").agg(F.avg("v").alias("output"), F.max("v").alias("ghi")), cams(s, d)).select("t", *r6("output", "ghi", "dni", "dhi")),
        f"with v as (select t, avg(v) as output, max(v) as ghi from ({VIEWS}) x group by t), c as (select t, max(dni) as dni, max(dhi) as dhi from ({CAMS}) x group by t) select v.t, round(output, 6) as output, round(ghi, 6) as ghi, round(dni, 6) as dni, round(dhi, 6) as dhi from v left join c on v.t = c.t",
    )
    q["bank_sum"] = (lambda s, d: two_banks(s, d).select("t", *r6("output")), f"with v as ({VIEWS}), b as (select t, avg(v*4.0D) as output from v group by t) select t, round(output*8/14 + output*6/14, 6) as output from b where minute(t) % 2 = 0")
    # energies are multiples of 1/120000: a billionth keeps both engines off the rounding ties
    off_tie = lambda: [F.round(F.col(c) + 1e-9, 6).alias(c) for c in METRICS if c.endswith("_wh")]
    q["day_metrics"] = (lambda s, d: metrics(s, d).select("day", "n_daytime", *r6(*METRICS[:8]), *off_tie()), f"with {DAYM} select day, n_daytime, {round_sql(METRICS[:8])}, {', '.join(f'round({c} + 1e-9, 6) as {c}' for c in METRICS[8:])} from dm")
    summ = [f"{m}_{k}" for m in ("rmse", "mae", "mbe", "r2") for k in ("base", "shaded")]
    kwh = [f"{k}_kwh" for k in ("real", "base", "shaded")]
    inner = f"select count(*) as days, {', '.join(f'avg({c}) as {c}' for c in summ)}, {', '.join(f'sum({k}_wh)/1000 as {k}_kwh' for k in ('real', 'base', 'shaded'))} from dm"
    q["performance_summary"] = (
        lambda s, d: PV.performance_summary(metrics(s, d)).select("days", *r6(*summ, *kwh, "rmse_change", "mae_change", "base_error", "shaded_error")),
        f"with {DAYM}, s as ({inner}) select days, {round_sql(summ + kwh)}, {', '.join(f'round({chg(f'{m}_shaded', f'{m}_base')}, 6) as {m}_change' for m in ('rmse', 'mae'))}, {', '.join(f'round({chg(f'{k}_kwh', 'real_kwh')}, 6) as {k}_error' for k in ('base', 'shaded'))} from s",
    )
    ee = f"e0 as (select *, {chg('base_wh', 'real_wh')} as base_error, {chg('shaded_wh', 'real_wh')} as shaded_error from dm), ee as (select *, abs(base_error) as base_abs_error, abs(shaded_error) as shaded_abs_error, abs(base_error)-abs(shaded_error) as error_gain, rmse_base-rmse_shaded as rmse_gain, mae_base-mae_shaded as mae_gain, r2_shaded-r2_base as r2_gain from e0)"
    errs = ["base_error", "shaded_error", "base_abs_error", "shaded_abs_error", "error_gain", "rmse_gain", "mae_gain", "r2_gain"]
    q["energy_error"] = (lambda s, d: PV.energy_error(metrics(s, d)).select("day", *r6(*errs)), f"with {DAYM}, {ee} select day, {round_sql(errs)} from ee")
    q["improvement_rank"] = (lambda s, d: gain(s, d).select("day", *r6("error_gain")).limit(50), f"with {DAYM}, {ee} select day, round(error_gain,6) as error_gain from ee order by ee.error_gain, day limit 50")
    q["bank_totals"] = (lambda s, d: PV.performance_summary(metrics(s, d)).select(*r6(*kwh), *(F.round(F.col(f"{k}_kwh") - F.col("real_kwh"), 6).alias(f"{k}_error_kwh") for k in ("base", "shaded"))), f"with {DAYM}, s as ({inner}) select {round_sql(kwh)}, round(base_kwh-real_kwh,6) as base_error_kwh, round(shaded_kwh-real_kwh,6) as shaded_error_kwh from s")
    box = ["q1", "median", "q3", "whisker_low", "whisker_high"]
    q["box_stats"] = (
        lambda s, d: ST.box_stats(metrics(s, d), "rmse_base").select("n", *r6(*box)),
        f"with {DAYM}, b as (select count(rmse_base) as n, min(rmse_base) as lo, max(rmse_base) as hi, quantile_cont(rmse_base, 0.25) as q1, quantile_cont(rmse_base, 0.5) as median, quantile_cont(rmse_base, 0.75) as q3 from dm) select n, {round_sql(['q1', 'median', 'q3'])}, round(greatest(lo, q1-1.5D*(q3-q1)),6) as whisker_low, round(least(hi, q3+1.5D*(q3-q1)),6) as whisker_high from b",
    )
    q["metric_spread"] = (lambda s, d: ST.spread(metrics(s, d), "rmse_base", "rmse_shaded").select(*r6("mean_rmse_base", "std_rmse_base", "mean_rmse_shaded", "std_rmse_shaded"), "improved", "n"), f"with {DAYM} select round(avg(rmse_base),6) as mean_rmse_base, round(stddev_samp(rmse_base),6) as std_rmse_base, round(avg(rmse_shaded),6) as mean_rmse_shaded, round(stddev_samp(rmse_shaded),6) as std_rmse_shaded, count(*) filter (where rmse_shaded < rmse_base) as improved, count(*) as n from dm")
    q["kde_scott"] = (
        lambda s, d: ST.kde(metrics(s, d), "rmse_base").select("i", *r6("x", "density")),
        f"with {DAYM}, v as (select rmse_base as v from dm where rmse_base is not null), f as (select min(v) as a, max(v) as b, stddev_samp(v)*pow(count(*), -0.2D) as h from v), g as (select cast(i as int) as i, a+(b-a)*i/199 as x, h from (select unnest(range(0, 200)) as i) s, f), k as (select i, x, sum(exp(-0.5D*((x-v)/h)*((x-v)/h))) as k from g, v group by i, x) select i, round(x,6) as x, round(k/(select max(k) from k), 6) as density from k",
    )
    q["linear_fit"] = (
        lambda s, d: ST.linear_fit(pairs(s, d).where("real > 50 or base > 50"), "base", "real").select(*r6("slope", "intercept", "r2"), "equation"),
        f"with p0 as ({PAIRS}), p as (select * from p0 where real > 50 or base > 50), f as (select regr_slope(real, base) as slope, regr_intercept(real, base) as intercept, 1 - sum((real-base)*(real-base))/sum((real-m)*(real-m)) as r2 from p, (select avg(real) as m from p) x) select {round_sql(['slope', 'intercept', 'r2'])}, printf('y = %.2fx %s %.2f', slope, case when intercept < 0 then '-' else '+' end, abs(intercept)) as equation from f",
    )
    desc = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    q["summary_describe"] = (
        lambda s, d: ST.describe(pairs(s, d), ["real", "base", "shaded"]).select("column", "count", *r6(*desc)),
        f"with p as ({PAIRS}), l as (select 'real' as c, real as v from p union all select 'base', base from p union all select 'shaded', shaded from p) select c as \"column\", count(v) as count, round(avg(v),6) as mean, round(stddev_samp(v),6) as std, round(min(v),6) as min, round(quantile_cont(v,0.25),6) as p25, round(quantile_cont(v,0.5),6) as p50, round(quantile_cont(v,0.75),6) as p75, round(max(v),6) as max from l group by c",
    )
    q["nearest_time_probe"] = (
        lambda s, d: probes(s, d).select("probe", "nearest", *r6("v")),
        f"with v as (select t, max(v) as v from ({VIEWS}) x group by t), i0 as ({INV}), p as (select distinct cast(cast(t as date) as timestamp) + interval '12 hours' as probe from i0), r as (select probe, t, v, row_number() over (partition by probe order by abs(epoch(t)::bigint - epoch(probe)::bigint), t) as rn from p join v on t between probe - interval '4 hours' - interval '1 second' and probe + interval '4 hours' + interval '1 second' and abs(floor(epoch(t))::bigint - epoch(probe)::bigint) <= 14400) select p.probe, r.t as nearest, round(r.v,6) as v from p left join r on p.probe = r.probe and rn = 1",
    )
    return {k: (f, duck(sql)) for k, (f, sql) in q.items()}
