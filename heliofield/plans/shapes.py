"""Queries on neighbourhoods: heights, features, scores, growth, clusters.

Searches take the points whose id is divisible by 20 against all points, as their SQL twins do by brute force; outliers, scores, growth and clusters are of all points or
all candidates. ``*_whole`` have every point as a query, without SQL. For candidates the roof is not known yet: its points are high vegetation.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from heliofield.functions import once
from heliofield.functions.packaging import ship
from heliofield.functions.storage import save
from heliofield.operators import neighbours as N
from heliofield.operators.points import candidates
from heliofield.plans.cloud import W, r6
from heliofield.plans.proxies import duck, pts

#: Rounded to all the digits that exact ones have (coordinates have two to four, there are ten points), so that no value is a tie.
COVARIANCES = ["cxx", "cyy", "czz", "cxy", "cxz", "cyz"]
FEATURES = ["planarity", "linearity", "sphericity", "anisotropy", "surface_variation", "omnivariance", "entropy"]


def roof(s, d):
    """The building points, as a cloud of their own."""
    return pts(s, d).where("cls = 6")


def scene(s, d):
    """The cloud, its columns computed once: tests of a class, or of a coordinate, would repeat what they are made of."""
    return once(pts(s, d))


def asked(s, d):
    """A twentieth of the points, as queries."""
    return pts(s, d).where("pid % 20 = 0")


def raw(s, d):
    """The cloud before buildings are told from high vegetation."""
    return scene(s, d).withColumn("cls", F.when(F.col("cls") == 6, 5).otherwise(F.col("cls")).cast("int"))


def unknown(s, d):
    """The candidates of that cloud."""
    return save(candidates(N.height_above_ground(raw(s, d))), "candidates")


def tall(s, d):
    """The cloud's candidates: unclassified and high vegetation points at a height above ground."""
    return save(candidates(N.height_above_ground(scene(s, d))), "candidates")


def toy(s, d, points=roof):
    """Points with deterministic scores and normals, for growth."""
    return points(s, d).select("pid", "x", "y", "z", (F.pmod("pid", F.lit(1000)) / 1000.0).alias("score"), (0.9 + F.pmod(F.floor(F.col("pid") / 7), F.lit(10)) / 100.0).alias("normal_z"))


R = f"{W}, roof as (select * from pts where cls = 6)"


def knn_sql(queries: str, points: str, k: int, axes: str, cell: float | str, out: str) -> str:
    """Brute force over neighbouring cells; right while k-th distances are below ``cell`` (a number, or SQL for one)."""
    cells = ", ".join(f"cast(floor({c}/{cell if isinstance(cell, str) else f'{cell}D'}) as int) as c{c}" for c in axes)
    around = " and ".join(f"n.c{c} = q.c{c} + o{c}" for c in axes)
    offsets = " cross join ".join(f"(select unnest([-1, 0, 1]) as o{c}) u{c}" for c in axes)
    dist = "sqrt(" + "+".join(f"(q.{c}-n.{c})*(q.{c}-n.{c})" for c in axes) + ")"
    return f"""{out} as (select pid, nid, dist, rank from (select q.pid, n.pid as nid, {dist} as dist, row_number() over (partition by q.pid order by {dist}, n.pid) as rank
  from (select *, {cells} from {queries}) q cross join {offsets} join (select *, {cells} from {points}) n on {around}) x where rank <= {k})"""


def near_sql(queries: str, points: str, k: int, out: str, cell: str | None = None, axes: str = "xyz") -> str:
    """The k nearest by brute force, or over neighbouring cells of a width that holds them (SQL; results differ if it does not)."""
    dist = "sqrt(" + "+".join(f"(q.{c}-n.{c})*(q.{c}-n.{c})" for c in axes) + ")"
    source = f"{queries} q, {points} n"
    if cell:
        cells = ", ".join(f"cast(floor({c}/({cell})) as int) as c{c}" for c in axes)
        steps = " cross join ".join(f"(select unnest([-1, 0, 1]) as o{c}) u{c}" for c in axes)
        source = f"(select *, {cells} from {queries}) q cross join {steps} join (select *, {cells} from {points}) n on {' and '.join(f'n.c{c} = q.c{c} + o{c}' for c in axes)}"
    return f"""{out}_l as (select q.pid, min({{'d': {dist}, 'n': n.pid}}, {k}) as l from {source} group by q.pid),
{out} as materialized (select pid, u.n as nid, u.d as dist, rank from (select pid, unnest(l) as u, unnest(range(1, len(l) + 1)) as rank from {out}_l) x)"""


def brute_sql(points: str, k: int, out: str) -> str:
    return near_sql(points, points, k, out)


def features_sql(edges: str, points: str, out: str) -> str:
    e = "case when {0} > 0 then -({0}/tt)*ln({0}/tt) else 0 end"
    return f"""{out}_c as (select e.pid, {", ".join(f"covar_samp(p.{a}, p.{b}) as c{a}{b}" for a, b in (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")))} from {edges} e join {points} p on p.pid = e.nid group by e.pid),
{out}_q as (select *, (cxx+cyy+czz)/3 as q from {out}_c),
{out}_p as (select *, sqrt(((cxx-q)*(cxx-q)+(cyy-q)*(cyy-q)+(czz-q)*(czz-q)+2*(cxy*cxy+cxz*cxz+cyz*cyz))/6) as p, (cxx-q)*((cyy-q)*(czz-q)-cyz*cyz) - cxy*(cxy*(czz-q)-cyz*cxz) + cxz*(cxy*cyz-(cyy-q)*cxz) as det from {out}_q),
{out}_f as (select *, acos(greatest(-1.0D, least(1.0D, case when p > 0 then det/(2*p*p*p) else 1 end)))/3 as phi from {out}_p),
{out}_l as (select *, q+2*p*cos(phi) as l1, q+2*p*cos(phi+{2 * math.pi / 3!r}D) as l3 from {out}_f),
{out}_e as (select *, greatest(l1, 0) as e1, greatest(3*q-l1-l3, 0) as e2, greatest(l3, 0) as e3, cxx-l3 as x_, cyy-l3 as y_, czz-l3 as z_ from {out}_l),
{out}_n as (select *, [{{'n': (cxy*cyz-cxz*y_)*(cxy*cyz-cxz*y_)+(cxz*cxy-x_*cyz)*(cxz*cxy-x_*cyz)+(x_*y_-cxy*cxy)*(x_*y_-cxy*cxy), 'k': x_*y_-cxy*cxy}},
  {{'n': (cxy*z_-cxz*cyz)*(cxy*z_-cxz*cyz)+(cxz*cxz-x_*z_)*(cxz*cxz-x_*z_)+(x_*cyz-cxy*cxz)*(x_*cyz-cxy*cxz), 'k': x_*cyz-cxy*cxz}},
  {{'n': (y_*z_-cyz*cyz)*(y_*z_-cyz*cyz)+(cyz*cxz-cxy*z_)*(cyz*cxz-cxy*z_)+(cxy*cyz-y_*cxz)*(cxy*cyz-y_*cxz), 'k': cxy*cyz-y_*cxz}}] as cr, case when e1 = 0 then 1 else e1 end as tp, case when e1+e2+e3 = 0 then 1 else e1+e2+e3 end as tt from {out}_e),
{out}_b as (select *, list_sort(cr)[3] as b from {out}_n),
{out} as (select pid, e1, e2, e3, (e2-e3)/tp as planarity, (e1-e2)/tp as linearity, e3/tp as sphericity, (e1-e3)/tp as anisotropy, e3/tt as surface_variation, cbrt(e1*e2*e3) as omnivariance, {" + ".join(e.format(x) for x in ("e1", "e2", "e3"))} as entropy,
  case when b.n > 0 then abs(b.k)/sqrt(b.n) else 0 end as normal_z from {out}_b)"""


def sig(x, c, k):
    return f"(1/(1+exp(-{k}D*({x}-{c}D))))"


def score_sql(weights):
    terms = (sig("planarity", 0.55, 15.0), f"(1-{sig('normal_z_std', 0.1, 30.0)})", f"(1-{sig('surface_variation', 0.05, 30.0)})", f"(1-{sig('entropy', 0.5, 12.0)})", f"(1-{sig('sphericity', 0.1, 20.0)})")
    return "exp(" + " + ".join(f"{w}D*ln(greatest({t}, 1e-10))" for t, w in zip(terms, weights, strict=True)) + ")"


def _scale_sql(points: str = "own", cell: str | None = None) -> str:
    parts = [near_sql(points, points, 40, "e40", cell)]
    for k in (10, 20, 40):
        parts += [f"k{k} as (select * from e40 where rank <= {k})", features_sql(f"k{k}", points, f"f{k}"), f"g{k} as materialized (select * from f{k})", f"s{k} as (select f.*, n.normal_z_std from g{k} f join (select e.pid, stddev_pop(g.normal_z) as normal_z_std from k{k} e join g{k} g on g.pid = e.nid group by e.pid) n on n.pid = f.pid)"]
    union = " union all ".join(f"select * from s{k}" for k in (10, 20, 40))
    parts.append(f"ms as materialized (select pid, max(planarity) as planarity, max(normal_z) as normal_z, min(linearity) as linearity, min(sphericity) as sphericity, min(surface_variation) as surface_variation, min(normal_z_std) as normal_z_std, min(entropy) as entropy from ({union}) u group by pid)")
    return ", ".join(parts)


def grow_sql(scored: str, seed: float, agreement: float, rounds: int = 5) -> str:
    """g{rounds}: pid, round. ``scored``: pid, x, y, z, score, normal_z."""
    dist = "sqrt((q.x-n.x)*(q.x-n.x)+(q.y-n.y)*(q.y-n.y)+(q.z-n.z)*(q.z-n.z))"
    parts = [f"g0 as (select pid, 0 as round from {scored} where score >= {seed}D)"]
    for i in range(1, rounds + 1):
        parts.append(f"""j{i} as (select q.pid, {i} as round from (select q.*, n.z as mz, n.normal_z as mn, row_number() over (partition by q.pid order by {dist}, n.pid) as rn from (select * from {scored} where pid not in (select pid from g{i - 1})) q join (select * from {scored} where pid in (select pid from g{i - 1})) n on {dist} <= 1.0D) q
  where rn = 1 and abs(z-mz) <= 1.5D and score >= 0.5D and abs(normal_z-mn) <= 1-{agreement}D), g{i} as materialized (select * from g{i - 1} union all select * from j{i})""")
    return ", ".join(parts)


def clusters_sql(points: str, eps: float, steps: int = 24, least: int = 10) -> str:
    """lb: pid, label of density clusters; least labels spread over ``steps`` links (results differ if a cluster is wider)."""
    parts = [
        f"ed as materialized (select a.pid, b.pid as nid from {points} a, {points} b where {DIST} <= {eps}D), co as materialized (select pid from ed group by pid having count(*) >= {least})",
        "ce as materialized (select ed.* from ed join co a on a.pid = ed.pid join co b on b.pid = ed.nid), l0 as (select pid, pid as label from co)",
        *(f"l{i} as materialized (select ce.pid, min(label) as label from ce join l{i - 1} m on m.pid = ce.nid group by ce.pid)" for i in range(1, steps + 1)),
        f"bo as (select ed.pid, min(cl.label) as label from ed join l{steps} cl on cl.pid = ed.nid where ed.pid not in (select pid from co) group by ed.pid)",
        f"lb as materialized (select p.pid, coalesce(cl.label, bo.label, -1) as label from {points} p left join l{steps} cl on cl.pid = p.pid left join bo on bo.pid = p.pid)",
    ]
    return ", ".join(parts)


DIST = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
#: Widths of cells that hold the nearest of a query: 21 of all points, 40 of the candidates.
WIDE, OWN_WIDE = "(select 6.5D*pow(60000.0D/count(*), 1.0D/3.0D) from {})", "(select 7.0D*pow(16400.0D/count(*), 1.0D/3.0D) from {})"


def stats_sql(points: str) -> str:
    return f"st as (select label, count(*) as size, max(x)-min(x) as dx, max(y)-min(y) as dy, max(z)-min(z) as dz, quantile_cont(z, 0.75)-quantile_cont(z, 0.25) as z_iqr from {points} p join lb on lb.pid = p.pid group by label)"


def verdict_sql(least: int) -> str:
    return f"case when label = -1 then 'noise' when size < {least} then 'size' when dx*dy < 20 then 'area' when least(dx,dy) < 2 then 'side' when greatest(dx,dy)/greatest(least(dx,dy),0.01D) > 10 then 'aspect' when z_iqr > 5 then 'z_iqr' when size/greatest(dx*dy,0.01D) < 0.25D then 'density' end"


def unknown_sql(cloud: str) -> str:
    """own: the candidates of ``cloud``."""
    return f"""gr as (select * from {cloud} where cls = 2), hi as (select * from {cloud} where cls in (1, 5)), {near_sql('hi', 'gr', 4, 'hk', '6.0D', 'xy')},
hg as (select hk.pid, sum(gr.z/greatest(dist, 1e-10))/sum(1/greatest(dist, 1e-10)) as b from hk join gr on gr.pid = hk.nid group by hk.pid),
own as materialized (select hi.* from hi join hg on hg.pid = hi.pid where greatest(hi.z - b, 0) between 2 and 50)"""


RAW = "raw as materialized (select pid, x, y, z, cast(case when cls = 6 then 5 else cls end as int) as cls from pts)"
UNKNOWN = f"{W}, {RAW}, {unknown_sql('raw')}"


def reclass_sql(cloud: str, least: int) -> str:
    """done: pid, cls of ``cloud`` with accepted clusters as buildings; ``own`` and ``ms`` are made before."""
    return f"""sc as materialized (select own.pid, x, y, z, normal_z, {score_sql(N.WEIGHTS["v3"])} as score from ms join own on own.pid = ms.pid), {grow_sql("sc", 0.7, 0.9)},
gn as materialized (select sc.pid, x, y, z from sc join g5 on g5.pid = sc.pid), {clusters_sql("gn", 1.5)}, {stats_sql("gn")},
done as (select c.pid, cast(case when ok.label is not null then 6 else cls end as int) as cls from {cloud} c left join lb on lb.pid = c.pid left join (select label from st where {verdict_sql(least)} is null) ok on ok.label = lb.label)"""


def whole():
    """Features and outliers of every point, and scores, growth and clusters of every candidate; no SQL, brute force is too slow there."""
    r4 = lambda *names: [F.round(n, 4).alias(n) for n in names]
    multi = ["planarity", "normal_z", "linearity", "sphericity", "surface_variation", "normal_z_std", "entropy"]

    def normal_std(s, d):
        return N.nearest_normal_spread(pts(s, d), 20).select("pid", *r4("normal_z_std"))

    def inliers(s, d):
        ship(s)
        return N.plane_inliers(pts(s, d)).select("pid", *r6("ransac"))

    def additive(s, d):
        own = tall(s, d)
        ship(s)
        return N.building_score_additive(N.multi_scale(own).join(N.plane_inliers(own), "pid")).select("pid", *r4("score"))

    def grow(s, d):
        own = save(toy(s, d, tall), "scored")
        return N.region_grow(own, own.where("score >= 0.97"), 1.0, 1.5, 0.5, 0.98)

    def clusters(s, d):
        own = tall(s, d)
        return N.cluster_stats(own, N.dbscan(own, 0.6))

    return {
        "knn_cloud_whole": lambda s, d: (lambda own: N.knn(own, own, 10))(pts(s, d)).select("pid", "nid", "rank", *r6("dist")),
        "outlier_removal_whole": lambda s, d: N.remove_outliers(pts(s, d), 20, 2.0).select("pid"),
        "neighbourhood_covariance_whole": lambda s, d: N.nearest_covariances(None, pts(s, d), 10).select("pid", *r6("cxx", "cyy", "czz", "cxy", "cxz", "cyz")),
        "eigen_features_whole": lambda s, d: N.eigen_features(N.nearest_covariances(None, pts(s, d), 20)).select("pid", *r4(*FEATURES, "normal_z")),
        "normal_std_whole": normal_std,
        "multi_scale_features_whole": lambda s, d: N.multi_scale(pts(s, d)).select("pid", *r4(*multi)),
        "building_score_whole": lambda s, d: N.building_score(N.multi_scale(tall(s, d)), "v3").select("pid", *r4("score")),
        "building_score_upgrade_whole": lambda s, d: N.building_score(N.multi_scale(tall(s, d)), "upgrade").select("pid", *r4("score")),
        "building_score_additive_whole": additive,
        "seed_filter_whole": lambda s, d: toy(s, d, tall).where("score >= 0.7").select("pid"),
        "plane_inlier_ratio_whole": inliers,
        "region_grow_whole": grow,
        "dbscan_labels_whole": lambda s, d: N.dbscan(tall(s, d), 0.6),
        "cluster_stats_whole": lambda s, d: clusters(s, d).select("label", "size", *r6("dx", "dy", "dz", "z_iqr")),
        "cluster_shape_rules_whole": lambda s, d: N.cluster_verdicts(clusters(s, d), 20),
    }


def queries():
    q = {k: (f, "") for k, f in whole().items()}
    shipped = lambda f: lambda s, d: (ship(s), f(s, d))[1]
    r4 = lambda *names: [F.round(n, 4).alias(n) for n in names]
    multi = ["planarity", "normal_z", "linearity", "sphericity", "surface_variation", "normal_z_std", "entropy"]
    q["knn_ground_hag"] = (lambda s, d: N.height_above_ground(scene(s, d)).select("pid", "cls", *r6("hag")), f"{W}, gr as (select * from pts where cls = 2), {knn_sql('pts', 'gr', 4, 'xy', 6.0, 'k')} select pts.pid, pts.cls, round(greatest(pts.z - b, 0), 6) as hag from pts join (select k.pid, sum(gr.z/greatest(dist, 1e-10))/sum(1/greatest(dist, 1e-10)) as b from k join gr on gr.pid = k.nid group by k.pid) w on w.pid = pts.pid")
    q["hag_nearest"] = (lambda s, d: N.to_height_above_ground(scene(s, d)).select("pid", "cls", *r6("z")), f"{W}, gr as (select * from pts where cls = 2), {knn_sql('pts', 'gr', 1, 'xy', 6.0, 'k')} select pts.pid, pts.cls, round(case when pts.cls = 2 then 0 else pts.z - gr.z end, 6) as z from pts join k on k.pid = pts.pid join gr on gr.pid = k.nid")
    ask = f"{W}, aq as (select * from pts where pid % 20 = 0)"
    q["knn_cloud"] = (lambda s, d: N.knn(asked(s, d), pts(s, d), 10).select("pid", "nid", "rank", *r6("dist")), f"{ask}, {near_sql('aq', 'pts', 10, 'k')} select pid, nid, cast(rank as int) as rank, round(dist,6) as dist from k")
    q["outlier_removal"] = (lambda s, d: N.remove_outliers(pts(s, d), 20, 2.0).select("pid"), f"{W}, {near_sql('pts', 'pts', 21, 'k', WIDE.format('pts'))}, m as (select pid, avg(dist) as d from k where rank > 1 group by pid) select pid from m where d < (select avg(d) + 2.0D*stddev_samp(d) from m)")
    q["neighbourhood_covariance"] = (lambda s, d: N.nearest_covariances(asked(s, d), pts(s, d), 10).select("pid", *(F.round(c, 9).alias(c) for c in COVARIANCES)), f"{ask}, {near_sql('aq', 'pts', 10, 'k')}, {features_sql('k', 'pts', 'f')} select pid, {', '.join(f'round({c},9) as {c}' for c in COVARIANCES)} from f_c")
    q["eigen_features"] = (lambda s, d: N.eigen_features(N.nearest_covariances(asked(s, d), pts(s, d), 20)).select("pid", *r4(*FEATURES, "normal_z")), f"{ask}, {near_sql('aq', 'pts', 20, 'k')}, {features_sql('k', 'pts', 'f')} select pid, {', '.join(f'round({c},4) as {c}' for c in (*FEATURES, 'normal_z'))} from f")
    scales = f"{UNKNOWN}, {_scale_sql('own', OWN_WIDE.format('own'))}"
    q["normal_std"] = (
        lambda s, d: N.nearest_normal_spread(unknown(s, d), 20).select("pid", *r4("normal_z_std")),
        f"{scales} select pid, round(normal_z_std, 4) as normal_z_std from s20",
    )
    q["multi_scale_features"] = (lambda s, d: N.multi_scale(unknown(s, d)).select("pid", *r4(*multi)), f"{scales} select pid, {', '.join(f'round({c},4) as {c}' for c in multi)} from ms")
    for v in ("v3", "upgrade"):
        q["building_score" + ("" if v == "v3" else "_upgrade")] = (lambda s, d, v=v: N.building_score(N.multi_scale(unknown(s, d)), v).select("pid", *r4("score")), f"{scales} select pid, round({score_sql(N.WEIGHTS[v])}, 4) as score from ms")

    def trip(points: str) -> str:
        return f"""cb as (select pid, a.i as i, b.i as j, c.i as l from (select distinct pid from k) p cross join (select unnest(range(1, 11)) as i) a join (select unnest(range(1, 11)) as i) b on b.i > a.i join (select unnest(range(1, 11)) as i) c on c.i > b.i),
kn as (select k.pid, k.rank, p.x, p.y, p.z from k join {points} p on p.pid = k.nid),
nr as (select cb.pid, cb.i, cb.j, cb.l, a.x, a.y, a.z, (b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y) as u, (b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z) as v, (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) as w from cb join kn a on a.pid = cb.pid and a.rank = i join kn b on b.pid = cb.pid and b.rank = j join kn c on c.pid = cb.pid and c.rank = l),
il as (select nr.pid, nr.i, nr.j, nr.l, avg(case when abs((p.x-nr.x)*u+(p.y-nr.y)*v+(p.z-nr.z)*w)/sqrt(u*u+v*v+w*w) <= 0.15D then 1.0D else 0.0D end) as r from nr join kn p on p.pid = nr.pid where u*u+v*v+w*w > 1e-24 group by nr.pid, nr.i, nr.j, nr.l)"""

    add = f"0.25D*{sig('planarity', 0.4, 12.0)} + 0.3D*{sig('ransac', 0.65, 15.0)} + 0.2D*(1-{sig('normal_z_std', 0.2, 20.0)}) + 0.1D*(1-{sig('sphericity', 0.3, 10.0)}) + 0.15D*(1-{sig('surface_variation', 0.15, 15.0)})"
    q["building_score_additive"] = (
        shipped(lambda s, d: (lambda own: N.building_score_additive(N.multi_scale(own).join(N.plane_inliers(own, queries=own.where("pid % 20 = 0")), "pid")))(unknown(s, d)).select("pid", *r4("score"))),
        f"{scales}, k as materialized (select * from e40 where rank <= 10 and pid % 20 = 0), {trip('own')}, m2 as (select ms.*, il2.ransac from ms join (select pid, max(r) as ransac from il group by pid) il2 on il2.pid = ms.pid) select pid, round({add}, 4) as score from m2",
    )
    q["seed_filter"] = (lambda s, d: N.building_score(N.multi_scale(unknown(s, d))).where("score >= 0.7").select("pid"), f"{scales} select pid from ms where {score_sql(N.WEIGHTS['v3'])} >= 0.7D")
    q["plane_inlier_ratio"] = (shipped(lambda s, d: N.plane_inliers(pts(s, d), queries=asked(s, d)).select("pid", *r6("ransac"))), f"{ask}, {near_sql('aq', 'pts', 10, 'k')}, {trip('pts')} select pid, round(max(r),6) as ransac from il group by pid")
    scored = f"{scales}, sc as materialized (select own.pid, x, y, z, normal_z, {score_sql(N.WEIGHTS['v3'])} as score from ms join own on own.pid = ms.pid)"

    def growth(s, d):
        own = unknown(s, d)
        known = save(N.building_score(N.multi_scale(own)), "scored")
        return N.region_grow(known, known.where("score >= 0.7"))

    q["region_grow"] = (growth, f"{scored}, {grow_sql('sc', 0.7, 0.9)} select pid, cast(round as int) as round from g5")
    dense = f"{UNKNOWN}, {clusters_sql('own', 0.6)}"
    q["dbscan_labels"] = (lambda s, d: N.dbscan(unknown(s, d), 0.6), f"{dense} select pid, label from lb")
    q["cluster_stats"] = (lambda s, d: (lambda own: N.cluster_stats(own, N.dbscan(own, 0.6)))(unknown(s, d)).select("label", "size", *r6("dx", "dy", "dz", "z_iqr")), f"{dense}, {stats_sql('own')} select label, size, round(dx,6) as dx, round(dy,6) as dy, round(dz,6) as dz, round(z_iqr,6) as z_iqr from st")
    q["cluster_shape_rules"] = (lambda s, d: (lambda own: N.cluster_verdicts(N.cluster_stats(own, N.dbscan(own, 0.6)), 20))(unknown(s, d)), f"{dense}, {stats_sql('own')} select label, size, {verdict_sql(20)} as reject from st")
    q["revert_small_clusters"] = (lambda s, d: N.revert_small_clusters(pts(s, d), 0.6, 10, 100).select("pid", "cls"), f"{R}, {clusters_sql('roof', 0.6)} select pts.pid, cast(case when lb.pid is null or label <> -1 and count(*) over (partition by label) >= 100 then cls else 5 end as int) as cls from pts left join lb on lb.pid = pts.pid")
    # a cell of 2.6 times the reach in which 20 points are expected holds the 20 nearest, at the scene's corners too
    trees = f"{W}, own as (select * from pts where cls = 5), cs as (select 2.6D*pow(223389.0D/count(*), 1.0D/3.0D) as c from own)"
    near = lambda k: f"{trees}, {knn_sql('own', 'own', k, 'xyz', '(select c from cs)', 'k')}, {features_sql('k', 'own', 'f')}"
    q["planarity_reclass"] = (lambda s, d: N.planarity_reclass(scene(s, d)).select("pid", "cls"), f"{near(20)} select pts.pid, cast(case when planarity > 0.7D and e1 > 1e-6 then 6 else cls end as int) as cls from pts left join f on f.pid = pts.pid")
    q["roof_edge_recovery"] = (
        lambda s, d: N.recover_roof_edges(scene(s, d)).select("pid", "cls"),
        f"""{near(15)}, rp as (select * from pts where cls = 6), nr as (select a.pid, a.z, b.z as rz, row_number() over (partition by a.pid order by {DIST}, b.pid) as rn from own a join rp b on {DIST} <= 1.5D)
select pts.pid, cast(case when nr.pid is not null and f.pid is not null then 6 else cls end as int) as cls from pts left join (select pid from nr where rn = 1 and abs(z-rz) < 0.5D) nr on nr.pid = pts.pid left join (select pid from f where planarity > 0.35D) f on f.pid = pts.pid""",
    )
    q["reclassify_buildings"] = (lambda s, d: N.reclassify_buildings(raw(s, d), min_size=50).select("pid", "cls"), f"{scales}, {reclass_sql('raw', 50)} select pid, cls from done")
    box = (2.0, 58.0, 2.0, 58.0)
    clean = f"""{W}, {RAW}, cr as materialized (select * from raw where x >= 2 and x <= 58 and y >= 2 and y <= 58), {near_sql('cr', 'cr', 21, 'ok_', WIDE.format('cr'))},
om as (select pid, avg(dist) as d from ok_ where rank > 1 group by pid), fl as materialized (select * from cr where pid in (select pid from om where d < (select avg(d) + 3.0D*stddev_samp(d) from om)) and cls in (2,3,4,5,6))"""
    q["cloud_pipeline"] = (lambda s, d: N.prepare_cloud(raw(s, d), box, min_size=50).select("pid", "cls"), f"{clean}, {unknown_sql('fl')}, {_scale_sql('own', OWN_WIDE.format('own'))}, {reclass_sql('fl', 50)} select pid, cls from done")
    return {k: (f, duck(sql)) for k, (f, sql) in q.items()}
