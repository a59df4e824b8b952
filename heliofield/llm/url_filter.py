"""URL filters: a path-template tree over each host, in DataFrame operations only.

Fixed rules judge first; their verdicts are the labels. Then the tree grows from the host downwards: digit runs are generalised inside
segments, and under each (already generalised) prefix the rare values of a position that has many of them become one wildcard, so what
follows a variable segment is generalised too. Below ``DEPTH`` segments the rest of a path is one segment.

A node's label counts are those of all pages below it. Siblings whose labels don't differ significantly from the other ones are merged:
they are judged by their pooled counts. The share of rejected pages is smoothed from the top: a host's towards the share of all pages, a
node's towards its parent's, so a template without labels is judged as its nearest labelled ancestor is. A template is rejected from
``purity`` on.

Counts are summed per (host, path shape) before anything is joined, and a position has at most ``RARE_OF + FEW_VALUES`` values after
generalisation, so no node has more children. Tables that are joined on a prefix are saved first: their sizes are then known, and
adaptive execution can split the rows of a hot host.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; a very long path is cut into segments like any
other; rules that tie in length go by code points; repeated rows are judged alike; an empty table gives an empty result; only ``page_id``
and ``url`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliofield.llm.runtime import save

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
PURITY = 0.8
SMOOTHING = 5
DEPTH = 6
#: Where a position has more rare values than this, they become a wildcard; a value is rare on one page or on at most one in ``RARE_OF``.
FEW_VALUES = 8
RARE_OF = 50
#: Chi-square of one degree of freedom at 5 %.
CHI_SQUARE = 3.84
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [(path.startswith(p) & ((host == h) | host.endswith("." + h)), h + p, v) for v, h, p in ordered]
    return F.coalesce(*(F.when(c, F.lit(name)) for c, name, _ in fits)), F.coalesce(*(F.when(c, F.lit(v)) for c, _, v in fits))


def templates(shapes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``shapes`` (host, shape, n, ...) with its ``template``."""
    segs = F.split("shape", "/")
    state = shapes.withColumn("segs", segs).withColumn("template", F.lit(""))
    longest = state.agg(F.max(F.size("segs")).alias("n")).first()["n"] or 1
    node = ["host", "template"]
    for k in range(1, min(longest - 1, depth) + 1):
        seg = F.array_join(F.slice("segs", F.lit(k + 1), F.size("segs")), "/") if k == depth else F.get("segs", F.lit(k))
        state = state.withColumn("seg", F.when(F.size("segs") > k, seg))
        values = save(state.where("seg is not null").groupBy(*node, "seg").agg(F.sum("n").alias("pages")), "url-values")
        total = save(values.groupBy(*node).agg(F.sum("pages").alias("total")), "url-nodes")
        rare = values.join(total, node).where(F.col("pages") * RARE_OF <= F.greatest("total", F.lit(RARE_OF)))
        many = save(rare.groupBy(*node).agg(F.count("*").alias("rare")).where(F.col("rare") > FEW_VALUES).select(*node), "url-wild-nodes")
        wild = save(rare.join(many, node).select(*node, "seg", F.lit(True).alias("wild")), "url-wild")
        met = state.join(wild, [*node, "seg"], "left")
        step = F.when(F.col("seg").isNull(), "").otherwise(F.concat(F.lit("/"), F.when(F.col("wild"), "*").otherwise(F.col("seg"))))
        state = save(met.withColumn("template", F.concat("template", step)).drop("seg", "wild"), "url-state")
    return state.drop("segs")


def tree(labelled: DataFrame) -> DataFrame:
    """(host, depth, node, parent, bad, good): the label counts of every node of the templates' tree; ``labelled``: host, template, bad, good."""
    steps = F.split("template", "/")
    each = labelled.withColumn("steps", steps).withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("steps") - 1)))
    prefix = lambda n: F.array_join(F.slice("steps", F.lit(1), n), "/")
    each = each.select("host", "depth", prefix(F.col("depth") + 1).alias("node"), F.when(F.col("depth") > 0, prefix(F.col("depth"))).alias("parent"), "bad", "good")
    return each.groupBy("host", "depth", "node", "parent").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def judge_templates(labelled: DataFrame, purity: float = PURITY, smoothing: int = SMOOTHING) -> DataFrame:
    """(host, template, bad, good) -> (host, node, share, rejected) of every node."""
    total = labelled.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("all_bad"), F.coalesce(F.sum(F.col("bad") + F.col("good")), F.lit(0)).alias("all_seen")).first()
    overall = float(total["all_bad"]) / max(total["all_seen"], 1)
    siblings = Window.partitionBy("host", "depth", "parent")  # of bounded size, see above
    x = tree(labelled).withColumn("rest_bad", F.sum("bad").over(siblings) - F.col("bad")).withColumn("rest_good", F.sum("good").over(siblings) - F.col("good"))
    a, b, c, d = (F.col(k).cast("double") for k in ("bad", "good", "rest_bad", "rest_good"))
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    apart = F.when(margins > 0, (a + b + c + d) * (a * d - b * c) * (a * d - b * c) >= CHI_SQUARE * margins).otherwise(F.lit(False))
    x = x.withColumn("apart", apart)
    pool = lambda k: F.sum(F.when(~F.col("apart"), F.col(k)).otherwise(0)).over(siblings)
    x = x.withColumn("pool_bad", pool("bad")).withColumn("pool_good", pool("good"))
    bad = F.when(F.col("apart"), F.col("bad")).otherwise(F.col("pool_bad"))
    seen = F.when(F.col("apart"), F.col("bad") + F.col("good")).otherwise(F.col("pool_bad") + F.col("pool_good"))
    nodes = save(x.select("host", "depth", "node", "parent", bad.cast("double").alias("bad"), seen.cast("double").alias("seen")), "url-tree")
    deepest = nodes.agg(F.max("depth").alias("n")).first()["n"] or 0
    level = nodes.where("depth = 0").withColumn("above", F.lit(overall))
    out = []
    for k in range(deepest + 1):
        share = (F.col("bad") + smoothing * F.col("above")) / (F.col("seen") + smoothing)
        done = save(level.select("host", "node", share.alias("share")), "url-shares")
        out.append(done)
        if k < deepest:
            level = nodes.where(F.col("depth") == k + 1).join(done.select("host", F.col("node").alias("parent"), F.col("share").alias("above")), ["host", "parent"])
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every.withColumn("rejected", F.col("share") >= purity)


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict, template, share (the method's smoothed share of rejected pages)."""
    host, path = split_url(F.col("url"))
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.withColumn("rule", rule).withColumn("said", said).withColumn("shape", F.regexp_replace("path", "[0-9]+", "{n}"))
    shapes = save(seen.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count_if(F.col("said") == "block").alias("bad"), F.count_if(F.col("said") == "allow").alias("good")), "url-shapes")
    shaped = templates(shapes)
    verdicts = save(judge_templates(shaped.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))), "url-verdicts")
    judged = save(shaped.select("host", "shape", "template").join(verdicts.withColumnRenamed("node", "template"), ["host", "template"]), "url-judged")
    return seen.join(judged, ["host", "shape"], "left").select("page_id", "url", "host", "path", "rule", F.coalesce("said", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template", "share")


def op9_url_templates(spark, sf_dir):
    from heliofield.llm.runtime import table

    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _level_sql(k: int) -> str:
    """The tree's k-th position in SQL: t<k> is t<k-1> with its templates one segment longer."""
    seg = f"case when len(segs) > {k} then " + (f"array_to_string(segs[{k + 1}:], '/')" if k == DEPTH else f"segs[{k + 1}]") + " end"
    return f"""
s{k} as (select *, {seg} as seg from t{k - 1}),
v{k} as (select host, template, seg, sum(n) as pages from s{k} where seg is not null group by all),
r{k} as (select * from (select *, sum(pages) over (partition by host, template) as total from v{k}) where pages * {RARE_OF} <= greatest(total, {RARE_OF})),
w{k} as (select host, template, seg from (select *, count(*) over (partition by host, template) as rare from r{k}) where rare > {FEW_VALUES}),
t{k} as (select s.host, s.shape, s.n, s.bad, s.good, s.segs, s.template || case when s.seg is null then '' when w.seg is not null then '/*' else '/' || s.seg end as template
    from s{k} s left join w{k} w on s.host = w.host and s.template = w.template and s.seg = w.seg),"""


def _share_sql(k: int) -> str:
    above = f"(select a.*, p.share as above from pooled a join e{k - 1} p on a.depth = {k} and a.host = p.host and a.parent = p.node)" if k else "(select a.*, (select b from o) as above from pooled a where depth = 0)"
    return f"e{k} as (select host, node, (bad + {SMOOTHING} * above) / (seen + {SMOOTHING}) as share from {above}),"


SQL = (
    r"""
with u as (select page_id, case when strpos(url, '://') > 0 then substring(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(verdict, rh, rp) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
s as (select h.*, (select first(rh || rp order by len(rh || rp) desc) from r where (host = rh or host like '%.' || rh) and starts_with(path, rp)) as rule,
    (select first(verdict order by len(rh || rp) desc) from r where (host = rh or host like '%.' || rh) and starts_with(path, rp)) as said, regexp_replace(path, '[0-9]+', '{n}', 'g') as shape from h),
t0 as (select host, shape, count(*) as n, count(*) filter (said = 'block') as bad, count(*) filter (said = 'allow') as good, string_split(shape, '/') as segs, '' as template from s group by host, shape),"""
    + "".join(map(_level_sql, range(1, DEPTH + 1)))
    + f"""
o as (select coalesce(sum(bad), 0)::double / greatest(coalesce(sum(bad + good), 0), 1) as b from t{DEPTH}),
a as (select host, bad, good, string_split(template, '/') as steps, unnest(range(len(string_split(template, '/')))) as depth from t{DEPTH}),
n as (select host, depth, array_to_string(steps[1:depth + 1], '/') as node, case when depth > 0 then array_to_string(steps[1:depth], '/') end as parent, sum(bad)::double as bad, sum(good)::double as good from a group by all),
x as (select *, sum(bad) over w - bad as rb, sum(good) over w - good as rg from n window w as (partition by host, depth, parent)),
y as (select *, ((bad + good) * (rb + rg) * (bad + rb) * (good + rg)) > 0 and (bad + good + rb + rg) * (bad * rg - good * rb) * (bad * rg - good * rb) >= {CHI_SQUARE} * ((bad + good) * (rb + rg) * (bad + rb) * (good + rg)) as apart from x),
z as (select *, sum(case when apart then 0 else bad end) over w as pb, sum(case when apart then 0 else good end) over w as pg from y window w as (partition by host, depth, parent)),
pooled as (select host, depth, node, parent, case when apart then bad else pb end as bad, case when apart then bad + good else pb + pg end as seen from z),
"""
    + "".join(map(_share_sql, range(DEPTH + 1)))
    + "\nevery_ as ("
    + " union all ".join(f"select * from e{k}" for k in range(DEPTH + 1))
    + f""")
select s.page_id, s.host, s.path, s.rule, coalesce(s.said, case when e.share >= {PURITY} then 'block' else 'allow' end) as verdict
from s join t{DEPTH} t on s.host = t.host and s.shape = t.shape join every_ e on t.host = e.host and t.template = e.node
"""
)
