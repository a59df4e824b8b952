"""The jobs over whole inputs, which have no SQL twin, against brute force on small fixtures."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from heliofield.plans import audits, light, shapes

CLOUD = "pid long, x double, y double, z double, cls int"
STEP = 17  # ids are this far apart, so that they spread over the scores made of them


@pytest.fixture(scope="module")
def scene():
    """Ground, shrubs, two crowns and a roof, in no order of class."""
    rng = np.random.default_rng(8)
    ground = np.c_[rng.random((80, 2)) * 8, rng.random(80) * 0.2]
    shrubs = np.c_[rng.random((20, 2)) * 8, 0.3 + rng.random(20)]
    crowns = np.concatenate([rng.normal((2, 2, 6), 0.4, (60, 3)), rng.normal((6, 5, 5), 0.5, (50, 3))])
    roof = np.c_[4 + rng.random((40, 2)) * 2, 3 + rng.random(40) * 0.05]
    p, cls = np.concatenate([ground, shrubs, crowns, roof]), np.repeat([2, 3, 5, 6], [80, 20, 110, 40])
    order = rng.permutation(len(p))
    return p[order], cls[order]


@pytest.fixture
def run(spark, scene, monkeypatch):
    p, cls = scene
    cloud = spark.createDataFrame([(STEP * i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(p, cls, strict=True))], CLOUD)
    monkeypatch.setattr(shapes, "pts", lambda s, d: cloud)
    return lambda name: shapes.queries()[name][0](spark, "").collect()


def distances(p):
    return np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))


def nearest(p, k):
    return np.argsort(distances(p), axis=1, kind="stable")[:, :k]


def features(p, near):
    out = {k: np.zeros(len(p)) for k in (*shapes.FEATURES, "normal_z")}
    for i, n in enumerate(near):
        value, vector = np.linalg.eigh(np.cov(p[n].T))
        e3, e2, e1 = np.maximum(value, 0)
        share = np.array([e for e in (e1, e2, e3) if e > 0]) / (e1 + e2 + e3)
        row = ((e2 - e3) / e1, (e1 - e2) / e1, e3 / e1, (e1 - e3) / e1, e3 / (e1 + e2 + e3), (e1 * e2 * e3) ** (1 / 3), -(share * np.log(share)).sum(), abs(vector[2, 0]))
        for k, v in zip(out, row, strict=True):
            out[k][i] = v
    return out


def many_scales(p):
    parts = []
    for k in (10, 20, 40):
        f = features(p, nearest(p, k))
        parts.append(f | {"normal_z_std": f["normal_z"][nearest(p, k)].std(1)})
    return {c: (np.max if c in ("planarity", "normal_z") else np.min)([x[c] for x in parts], axis=0) for c in parts[0]}


def inliers(p):
    out = []
    for n in p[nearest(p, 10)]:
        best = 0.0
        for a, b, c in itertools.combinations(n, 3):
            normal = np.cross(b - a, c - a)
            if np.linalg.norm(normal) > 1e-12:
                best = max(best, (np.abs((n - a) @ normal) / np.linalg.norm(normal) <= 0.15).mean())
        out.append(best)
    return np.array(out)


def tall(p, cls):
    """Numbers of the candidates: high vegetation 2 to 50 m over the weighted mean of the four nearest ground points."""
    ground = p[cls == 2]
    out = []
    for i in np.flatnonzero(np.isin(cls, (1, 5))):
        d = np.sqrt(((ground[:, :2] - p[i, :2]) ** 2).sum(1))
        n = np.argsort(d)[:4]
        w = 1 / np.maximum(d[n], 1e-10)
        if 2 <= max(p[i, 2] - (w * ground[n, 2]).sum() / w.sum(), 0) <= 50:
            out.append(i)
    return np.array(out)


def logistic(x, centre, steepness):
    return 1 / (1 + np.exp(-steepness * (x - centre)))


def same(rows, name, ids, want, tolerance=2e-4):
    got = {r["pid"]: r[name] for r in rows}
    assert sorted(got) == sorted(ids)
    assert [got[i] for i in ids] == pytest.approx(list(want), abs=tolerance)


def test_features_are_those_of_every_point(run, scene):
    p, _ = scene
    ids = [STEP * i for i in range(len(p))]
    near = nearest(p, 10)
    assert {(r.pid, r["rank"]): r.nid for r in run("knn_cloud_whole")} == {(STEP * i, k + 1): STEP * near[i, k] for i in range(len(p)) for k in range(10)}
    mean = np.sort(distances(p), axis=1)[:, 1:21].mean(1)
    assert {r.pid for r in run("outlier_removal_whole")} == set(STEP * np.flatnonzero(mean < mean.mean() + 2 * mean.std(ddof=1)))
    cov = np.array([np.cov(p[n].T) for n in near])
    rows = run("neighbourhood_covariance_whole")
    for a, b in itertools.combinations_with_replacement(range(3), 2):
        same(rows, f"c{'xyz'[a]}{'xyz'[b]}", ids, cov[:, a, b], 2e-6)
    f = features(p, nearest(p, 20))
    rows = run("eigen_features_whole")
    for k in f:
        same(rows, k, ids, f[k])
    same(run("normal_std_whole"), "normal_z_std", ids, f["normal_z"][nearest(p, 20)].std(1))
    rows, want = run("multi_scale_features_whole"), many_scales(p)
    for k in ("planarity", "normal_z", "linearity", "sphericity", "surface_variation", "normal_z_std", "entropy"):
        same(rows, k, ids, want[k])
    same(run("plane_inlier_ratio_whole"), "ransac", ids, inliers(p), 1e-6)


def test_scores_are_those_of_every_candidate(run, scene):
    at = tall(*scene)
    ids, p = STEP * at, scene[0][at]
    m = many_scales(p)
    terms = [logistic(m["planarity"], 0.55, 15), *(1 - logistic(m[k], c, s) for k, c, s in (("normal_z_std", 0.1, 30), ("surface_variation", 0.05, 30), ("entropy", 0.5, 12), ("sphericity", 0.1, 20)))]
    for name, weights in (("", (0.25, 0.3, 0.2, 0.15, 0.1)), ("_upgrade", (0.3, 0.3, 0.15, 0.15, 0.1))):
        same(run(f"building_score{name}_whole"), "score", ids, np.exp(sum(w * np.log(np.maximum(t, 1e-10)) for w, t in zip(weights, terms, strict=True))))
    want = 0.25 * logistic(m["planarity"], 0.4, 12) + 0.3 * logistic(inliers(p), 0.65, 15) + 0.2 * (1 - logistic(m["normal_z_std"], 0.2, 20)) + 0.1 * (1 - logistic(m["sphericity"], 0.3, 10)) + 0.15 * (1 - logistic(m["surface_variation"], 0.15, 15))
    same(run("building_score_additive_whole"), "score", ids, want)


def test_growth_and_clusters_are_those_of_every_candidate(run, scene):
    at = tall(*scene)
    ids, p = STEP * at, scene[0][at]
    d = distances(p)
    score, normal = ids % 1000 / 1000, 0.9 + ids // 7 % 10 / 100
    assert {r.pid for r in run("seed_filter_whole")} == set(ids[score >= 0.7])
    grown = dict.fromkeys(np.flatnonzero(score >= 0.97), 0)
    for number in range(1, 6):
        members = np.array(sorted(grown))
        joined = []
        for i in set(range(len(p))) - set(grown):
            j = members[np.argmin(d[i, members])]
            if d[i, j] <= 1 and abs(p[i, 2] - p[j, 2]) <= 1.5 and score[i] >= 0.5 and abs(normal[i] - normal[j]) <= 1 - 0.98:
                joined.append(i)
        grown |= dict.fromkeys(joined, number)
    assert max(grown.values()) >= 2
    assert {r.pid: r["round"] for r in run("region_grow_whole")} == {ids[i]: k for i, k in grown.items()}
    label = np.full(len(p), -1)
    core = (d <= 0.6).sum(1) >= 10
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = ids[i]
                    todo += list(np.flatnonzero(core & (d[j] <= 0.6)))
    for i in np.flatnonzero(~core):
        label[i] = min((label[j] for j in np.flatnonzero(core & (d[i] <= 0.6))), default=-1)
    assert len(set(label)) >= 3
    assert {r.pid: r.label for r in run("dbscan_labels_whole")} == dict(zip(ids, label, strict=True))
    stats = {r.label: r for r in run("cluster_stats_whole")}
    rules = {r.label: r for r in run("cluster_shape_rules_whole")}
    assert set(stats) == set(rules) == set(label)
    for k in set(label):
        own = p[label == k]
        side = np.ptp(own, axis=0)
        assert [stats[k].size, stats[k].dx, stats[k].dy, stats[k].dz] == pytest.approx([len(own), *side], abs=1e-6)
        assert stats[k].z_iqr == pytest.approx(np.subtract(*np.quantile(own[:, 2], [0.75, 0.25])), abs=1e-6)
        assert rules[k].reject == ("noise" if k == -1 else "size" if len(own) < 20 else "area")  # crowns are under 20 square metres


def test_sweeps_have_every_direction(spark):
    d = "/root/testdata/sf0.001"
    few = {(r.alt, r.az): r.shadow for r in light.queries()["sky_sweep"][0](spark, d).collect()}
    got = {(r.alt, r.az): r.shadow for r in light.queries()["sky_sweep_whole"][0](spark, d).collect()}
    assert set(got) == {(float(a), float(z)) for a in range(91) for z in range(361)}
    assert all(got[0.0, float(z)] == 1 for z in range(361)) and all(got[float(a), 360.0] == got[float(a), 0.0] for a in range(91))
    assert all(got[k] == pytest.approx(v, abs=2e-6) for k, v in few.items())
    capped = {(r.alt, r.az): r.shadow for r in audits.queries()["sky_sweep_capped_whole"][0](spark, d).collect()}
    assert all(capped[a, z] == pytest.approx(got[a, z], abs=2e-6) for a in range(56) for z in range(360))
    assert all(v is None for (a, z), v in capped.items() if a > 55 or z == 360)
