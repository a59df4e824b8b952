"""Queries on logger clocks: gaps, duplicates, clock changes, offset detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliofield.operators import forensics as FO
from heliofield.plans.cloud import r6
from heliofield.plans.power import INV_SQL, inv, sun_sql
from heliofield.plans.proxies import INV, duck

GAPS = f"{INV_SQL}, g as (select event_id, t, e, prev_t, dt_min as gap_min, case when dt_min is null then null when abs(dt_min-5) < 0.5D then 'normal' when abs(dt_min-60) < 0.5D then 'one_hour' when dt_min > 60.5D then 'large' when abs(dt_min) < 0.5D then 'duplicate' when dt_min < -0.5D then 'backwards' else 'other' end as kind from i2)"
KINDS = ("normal", "one_hour", "large", "duplicate", "backwards", "other")
SUNDAY = "last_day(make_date(cast(y as int), {0}, 1)) - cast(dayofweek(last_day(make_date(cast(y as int), {0}, 1))) as int)"
TRANS = f"""ys as (select distinct year(t) as y from i0), w as (select y, 'spring' as season, {SUNDAY.format(3)} as day from ys union all select y, 'autumn', {SUNDAY.format(10)} from ys),
sn as (select cast(t as date) as day, count(*) as records, count(*) filter (where kind='duplicate') as du, count(*) filter (where kind='backwards') as ba, count(*) filter (where kind='one_hour' and hour(t) in (3,4)) as sg from g group by 1),
tr as (select cast(y as int) as year, season, w.day, coalesce(records, 0) as records, case when season='autumn' then case when ba > 0 then 'backwards' when du > 0 then 'duplicates' when records > 290 then 'long_day' else 'none' end else case when sg > 0 then 'one_hour_gap' else 'none' end end as evidence from w left join sn on w.day = sn.day)"""
OFFS = f"""i0 as ({INV}), on_ as (select cast(t as date) as day, min(t) as onset from i0 where e > 0.05D group by 1), ms as (select day, unnest(generate_series(cast(day as timestamp), cast(day as timestamp) + interval '1439 minutes', interval '1 minute')) as ts from on_), {sun_sql('ms', 'ts', 'sp')},
sr as (select day, min(ts) as sunrise from sp where elevation > 0 group by day), ofs as (select on_.day, onset, sunrise, (epoch(onset)-epoch(sunrise))/3600.0D as oh from on_ join sr on on_.day = sr.day), ro as (select *, cast(round_even(oh, 0) as int) as o from ofs)"""


def gaps(s, d):
    return FO.intervals(inv(s, d))


def offsets(s, d):
    return FO.day_offsets(inv(s, d))


def queries():
    q = {}
    q["interval_classes"] = (lambda s, d: FO.interval_classes(gaps(s, d)), f"with {GAPS} select min(t) as first_t, max(t) as last_t, count(*) as n, {', '.join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in KINDS)} from g")
    for kind, k in (("large", 20), ("other", 15)):
        q[f"gap_details_{kind}"] = (lambda s, d, kind=kind, k=k: FO.top_gaps(gaps(s, d), kind, k).select("prev_t", "t", *r6("gap_min")), f"with {GAPS} select prev_t, t, round(gap_min,6) as gap_min from g where kind = '{kind}' order by g.gap_min desc, t, event_id limit {k}")
    q["gap_details_top5"] = (lambda s, d: gaps(s, d).orderBy(F.desc_nulls_last("gap_min"), "t", "event_id").limit(5).select("t", *r6("gap_min")), f"with {GAPS} select t, round(gap_min,6) as gap_min from g order by g.gap_min desc nulls last, t, event_id limit 5")
    q["daily_count_anomalies"] = (lambda s, d: FO.day_anomalies(inv(s, d)), f"with i0 as ({INV}), c as (select cast(t as date) as day, count(*) as n from i0 group by 1) select day, n, case when n < 286 then 'short' else 'long' end as kind from c where n < 286 or n > 290")
    q["duplicate_timestamps"] = (lambda s, d: FO.duplicate_members(inv(s, d)).select("t", "event_id", "n", *r6("e")), f"with i0 as ({INV}), c as (select *, count(*) over (partition by t) as n from i0) select t, event_id, n, round(e,6) as e from c where n > 1")
    q["dst_transitions"] = (lambda s, d: FO.dst_transitions(inv(s, d), gaps(s, d)), f"with {GAPS}, {TRANS} select year, season, day, records, evidence from tr")
    q["clock_conclusion"] = (
        lambda s, d: FO.conclusion(FO.dst_transitions(inv(s, d), gaps(s, d)), gaps(s, d)),
        f"with {GAPS}, {TRANS}, a as (select count(*) filter (where season='spring' and evidence <> 'none') as spring from tr), b as (select count(*) filter (where kind in ('large','one_hour')) as large from g) select spring, large, case when spring > 0 then 'local_dst' when large > 0 then 'fixed_with_downtime' else 'fixed' end as conclusion from a, b",
    )
    q["first_onset"] = (lambda s, d: FO.first_onset(inv(s, d)), f"with i0 as ({INV}) select cast(t as date) as day, min(t) as onset from i0 where e > 0.05D group by 1")
    q["day_offsets"] = (lambda s, d: offsets(s, d).select("day", "onset", "sunrise", *r6("offset_hours")), f"with {OFFS} select day, onset, sunrise, round(oh,6) as offset_hours from ofs")
    q["utc_offset_histogram"] = (lambda s, d: FO.offset_histogram(offsets(s, d)).select("offset", "n", *r6("pct")), f'with {OFFS} select o as "offset", count(*) as n, round(100.0D*count(*)/sum(count(*)) over (), 6) as pct from ro group by o')
    q["utc_offset_mode"] = (lambda s, d: FO.offset_mode(offsets(s, d)).select("offset", "days", *r6("median_hours", "delay_min")), f'with {OFFS}, m as (select o from ro group by o order by count(*) desc, o limit 1) select o as "offset", count(*) as days, round(median(oh),6) as median_hours, round((median(oh)-o)*60,6) as delay_min from ro where o = (select o from m) group by o')
    q["seasonal_offset"] = (
        lambda s, d: FO.seasonal_offset(offsets(s, d)).select(*r6("winter", "summer"), "shifted"),
        f"with {OFFS}, m as (select median(case when month(day) in (1,2,3,10,11,12) then cast(o as double) end) as winter, median(case when month(day) between 4 and 9 then cast(o as double) end) as summer from ro) select round(winter,6) as winter, round(summer,6) as summer, coalesce(abs(winter-summer) >= 0.8D, false) as shifted from m",
    )
    q["chain_landmarks"] = (
        lambda s, d: FO.landmarks(inv(s, d), "e").select("day", "peak_at", "above_at", *r6("mean_0h", "mean_12h")),
        f"with i0 as ({INV}), r as (select *, cast(t as date) as day, row_number() over (partition by cast(t as date) order by e desc, t) as rn from i0) select day, min(case when rn = 1 then t end) as peak_at, min(case when e > 100 then t end) as above_at, round(avg(case when hour(t) = 0 then e end),6) as mean_0h, round(avg(case when hour(t) = 12 then e end),6) as mean_12h from r group by day",
    )
    q["interval_histogram"] = (lambda s, d: gaps(s, d).where("gap_min is not null").groupBy(F.least(F.lit(180), F.rint("gap_min").cast("int")).alias("minutes")).agg(F.count("*").alias("n")), f"with {GAPS} select least(180, cast(round_even(gap_min, 0) as int)) as minutes, count(*) as n from g where gap_min is not null group by 1")
    q["daily_counts_by_month"] = (lambda s, d: inv(s, d).groupBy(F.month("t").alias("month"), F.to_date("t").alias("day")).agg(F.count("*").alias("n")).groupBy("month").agg(F.count("*").alias("days"), F.min("n").alias("least"), F.max("n").alias("most")), f"with i0 as ({INV}), c as (select cast(t as date) as day, count(*) as n from i0 group by 1) select cast(month(day) as int) as month, count(*) as days, min(n) as least, max(n) as most from c group by 1")
    return {k: (f, duck(sql)) for k, (f, sql) in q.items()}
