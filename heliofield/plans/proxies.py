"""Deterministic inputs for the registered queries, by the same SQL in Spark and in DuckDB.

SQL is written in Spark's form; ``duck`` turns its double literals (``1.5D``) into DuckDB's.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PTS = """select pid, x, y, 100.0D + case cls when 2 then u*0.0003D when 3 then 0.3D+u*0.0017D
    when 4 then 2.0D+u*0.003D when 5 then 5.0D+u*0.013D else 6.0D+(x-25.0D)*0.2D end as z, cls
from (select pid, x, y, u, cast(case when x>=25 and x<35 and y>=25 and y<35 and r<80 then 6
    when r<45 then 2 when r<60 then 3 when r<75 then 4 else 5 end as int) as cls
  from (select ((l_orderkey*8+l_linenumber)*20000+l_partkey)*100000000 + cast(round(l_extendedprice*100.0D) as bigint) as pid,
    ((l_orderkey*3701 + l_linenumber*1109) % 6000)/100.0D as x,
    ((l_partkey*5303 + l_suppkey*1709 + l_linenumber*2909 + l_orderkey*17) % 6000)/100.0D as y,
    (l_orderkey*13 + l_partkey*7 + l_linenumber*31) % 100 as r,
    (l_partkey*11 + l_orderkey*7 + l_linenumber*5) % 1000 as u from {lineitem}) p) s"""

_PLACE, _CENTS = "((l_orderkey*8+l_linenumber)*20000+l_partkey)", "cast(round(l_extendedprice*100.0D) as bigint)"
_PID = f"{_PLACE}*100000000 + {_CENTS}"
#: The same number where it fits 64 bits, else its remainder by 2^63 (from order 576,460 on the SQL's product overflows in both engines).
_WIDE_PID = f"case when abs({_PLACE}) < 90000000000 then {_PID} else cast((cast({_PLACE} as decimal(20, 0))*100000000 + {_CENTS}) % 9223372036854775808 as bigint) end"

INV = "select date_trunc('minute', ts) as t, event_id, value as e from {events}"
TEMP = "select date_trunc('minute', ts) as t, avg(value)/10.0D - 10.0D as temp, avg(value % 7.0D) as wind from {events} where event_type = 'signup' group by 1"
RAD = "select date_trunc('minute', ts) as t, avg(value)*3.0D as ghi, avg(value) as dhi from {events} where event_type = 'view' group by 1"
CAMS = "select ts as t, event_id, value as dni, value*1.5D as ghi, value*0.5D as dhi from {events} where event_type = 'purchase'"
VIEWS = "select ts as t, event_id, value as v from {events} where event_type = 'view'"
PAIRS = """select o_orderdate as day, l_orderkey*8 + l_linenumber as k, l_partkey as k2, l_extendedprice as k3, l_extendedprice/20.0D as real,
    l_extendedprice/20.0D*(1.0D+l_tax)+l_quantity as base, (l_extendedprice/20.0D*(1.0D+l_tax)+l_quantity)*(1.0D-l_discount) as shaded
from {lineitem} join {orders} on l_orderkey = o_orderkey"""


def duck(sql: str) -> str:
    return re.sub(r"\b(\d+(?:\.\d+)?(?:e-?\d+)?)D\b", r"cast(\1 as double)", re.sub(r"\{(\w+)\}", r"\1", sql))


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, PTS.replace(_PID, _WIDE_PID))


#: Seen shade by direction; directions that the table doesn't have follow a formula.
SEEN = "select cast((l_orderkey*7 + l_linenumber) % 91 as int) as s_alt, cast((l_partkey*13 + l_suppkey) % 361 as int) as s_az, round(avg(l_discount)*10.0D, 9) as seen from {lineitem} group by 1, 2"
_SHADE = "greatest(0.0D, least(1.0D, coalesce(seen, 0.5D + 0.5D*sin(radians(z.az*3))*cos(radians(a.alt)))))"
MATRIX = f"""select cast(a.alt as int) as alt, cast(z.az as int) as az, {_SHADE} as shadow
    from (select unnest(range(0, 91)) as alt) a cross join (select unnest(range(0, 361)) as az) z left join ({SEEN}) s on s.s_alt = a.alt and s.s_az = z.az"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full matrix of 91 x 361 directions, measured ones from the table."""
    return frame(spark, sf_dir, f"select cast(a.alt as int) as alt, cast(z.az as int) as az, {_SHADE} as shadow from (select id as alt from range(0, 91)) a cross join (select id as az from range(0, 361)) z left join ({SEEN}) s on s.s_alt = a.alt and s.s_az = z.az")
