"""The balanced partition of space, and the searches and clusters made on it, against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from heliofield.operators import neighbours, space


def frame(spark, p, ids=None, parts=4):
    axes = "xyz"[: p.shape[1]]
    ids = range(len(p)) if ids is None else ids
    return spark.createDataFrame([(int(i), *map(float, r)) for i, r in zip(ids, p, strict=True)], f"pid long, {', '.join(f'{c} double' for c in axes)}").repartition(parts)


def distances(a, b):
    total = None
    for k in range(a.shape[1]):
        d = a[:, k, None] - b[None, :, k]
        total = d * d if total is None else total + d * d
    return np.sqrt(total)


def nearest(q, p, ids, k):
    d = distances(q, p)
    return [[(int(ids[j]), d[i, j]) for j in np.lexsort((ids, d[i]))[:k]] for i in range(len(q))]


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.pid, r["rank"])):
        out.setdefault(r.pid, []).append((r.nid, r.dist))
    return out


@pytest.mark.parametrize("kind", ["clumps", "ties", "line", "one place"])
def test_tree(kind):
    rng = np.random.default_rng(2)
    p = rng.normal(0, 1, (3000, 3))
    if kind == "clumps":
        p[:2000] *= 0.01
    elif kind == "ties":
        p = np.round(p * 2)
    elif kind == "line":
        p[:, 1:] = 0
    else:
        p[:] = 1.5
    tree = space.Tree(p, 40)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(3000))
    home = tree.locate(p)
    for k, own in enumerate(tree.leaves):
        assert (home[own] == k).all() and (len(own) <= 40 or len(np.unique(p[own], axis=0)) == 1)
    q, r = rng.normal(0, 1, (50, 3)), rng.random(50)
    place, leaf = tree.reach(q, r)
    met = set(zip(place.tolist(), leaf.tolist(), strict=True))
    assert len(met) == len(place)
    for i in range(50):
        assert {int(home[j]) for j in np.flatnonzero(distances(q[i : i + 1], p)[0] <= r[i])} <= {m for j, m in met if j == i}


@pytest.mark.parametrize(("kind", "axes", "k", "cell"), [("clumps", 3, 5, 150), ("ties", 2, 7, 100), ("hot", 3, 6, 300), ("sparse", 2, 1, 60), ("few", 3, 9, 8192)])
def test_knn_over_many_cells(spark, monkeypatch, kind, axes, k, cell):
    rng = np.random.default_rng(6)
    p = rng.normal(0, 1, (2500 if kind != "few" else 4, axes))
    if kind == "clumps":
        p[:1500] *= 0.01
        p[-10:] *= 100
    elif kind == "ties":
        p = np.round(p * 3) / 2
    elif kind == "hot":  # two fifths at one place
        p[:1000] = p[0]
        monkeypatch.setattr(space, "CELL", 800)
    monkeypatch.setattr(space, "QUERIES", 100)  # cells are shared between tasks
    ids = rng.permutation(len(p)) * 3
    q = rng.normal(0, 3, (400, axes)) if kind == "sparse" else p
    qid = np.arange(len(q)) if kind == "sparse" else ids
    got = found(space.knn(frame(spark, q, qid), frame(spark, p, ids), k, "xyz"[:axes], cell).collect())
    want = nearest(q, p, ids, k)
    assert all(got[int(qid[i])] == want[i] for i in range(len(q))) and len(got) == len(q)


def test_knn_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 0.0), (4, 2.0, 0.0), (4, 2.0, 0.0)], "pid long, x double, y double")
    got = sorted((r.pid, r.nid, r.dist, r["rank"]) for r in space.knn(rows.where("pid < 4"), rows, 2, "xy").collect())
    assert got == [(1, 1, 0.0, 1), (1, 4, 2.0, 2)]
    assert space.knn(rows, rows.limit(0), 2, "xy").count() == 0 and space.knn(rows.limit(0), rows, 2, "xy").count() == 0


def clusters(p, eps, least):
    d = distances(p, p)
    core = (d <= eps).sum(1) >= least
    label = np.full(len(p), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = i
                    todo += list(np.flatnonzero(core & (d[j] <= eps)))
    for i in np.flatnonzero(~core):
        label[i] = min((label[j] for j in np.flatnonzero(core & (d[i] <= eps))), default=-1)
    return label


@pytest.mark.parametrize(("kind", "eps", "least"), [("blobs", 0.5, 8), ("lattice", 1.0, 5), ("dense", 0.4, 10), ("touching", 0.5, 4), ("all apart", 0.01, 3)])
def test_dbscan_by_cells(spark, monkeypatch, kind, eps, least):
    rng = np.random.default_rng(12)
    if kind == "lattice":  # distances of exactly eps
        p = np.array([(x, y, 0.0) for x in range(12) for y in range(12) if (x + y) % 7], float)
    elif kind == "dense":
        p = np.concatenate([rng.normal(0, 0.1, (400, 3)), rng.normal((2, 0, 0), 0.1, (300, 3)), np.repeat([[1.0, 1.0, 1.0]], 150, 0), rng.random((100, 3)) * 4 - 1])
    elif kind == "touching":  # slabs just within, and just beyond, reach of each other
        side = np.arange(0, 2, 0.1)
        sheet = np.array([(0, y, z) for y in side for z in side])
        p = np.concatenate([sheet, sheet + (0.499, 0.03, 0.01), sheet + (1.01, 0.0, 0.0)])
    else:
        p = np.concatenate([rng.normal(c, 0.35, (150, 3)) for c in ((0, 0, 0), (2, 0, 0), (0, 5, 1))] + [rng.random((80, 3)) * 8 - 2])
    monkeypatch.setattr(space, "QUERIES", 50)
    got = {r.pid: r.label for r in neighbours.dbscan(frame(spark, p), eps, least).collect()}
    assert [got[i] for i in range(len(p))] == clusters(p, eps, least).tolist()


@pytest.mark.parametrize(("margin", "within"), [("guessed", np.inf), ("none", np.inf), ("none", 0.4), ("guessed", 0.4)])
def test_answers_with_values(spark, monkeypatch, margin, within):
    rng = np.random.default_rng(4)
    p, v = rng.normal(0, 1, (1500, 3)), rng.random(1500)
    p[:300] = np.round(p[:300] * 2)
    p[-200:] *= 0.02
    if margin == "none":  # all balls that leave a cell go on
        monkeypatch.setattr(space, "_margins", lambda tree, *_: np.zeros(len(tree.leaves)))
    rows = spark.createDataFrame([(i, *map(float, r), float(x), f"n{i}") for i, (r, x) in enumerate(zip(p, v, strict=True))], "pid long, x double, y double, z double, v double, name string").repartition(4)

    def fold(found):
        return [found.values[:, :, 0].sum(1), found.ids[:, -1], found.at[:, -1, 2], found.dist[:, -1]]

    got = {r.pid: r for r in space.answers(None, rows, 6, fold, "s double, last long, z_last double, far double", values=("v",), carry=("name",), within=within, cell=100).collect()}
    assert len(got) == len(p)
    for i, near in enumerate(nearest(p, p, np.arange(len(p)), 6)):
        near = [(j, d) for j, d in near if d <= within]
        r = got[i]
        assert (r.name, r.found, r.last, r.z_last, r.far) == (f"n{i}", len(near), near[-1][0], p[near[-1][0], 2], near[-1][1])
        assert r.s == pytest.approx(sum(v[j] for j, _ in near))


@pytest.mark.parametrize("job", ["scales", "covariances", "normals", "outliers", "planes", "growth", "heights", "clusters"])
def test_no_table_of_pairs(spark, monkeypatch, job):
    """What is saved follows the points: a row each, not k."""
    rng = np.random.default_rng(5)
    cloud = spark.createDataFrame([(i, *map(float, r), int(2 + i % 2 * 3), i % 100 / 100, 1.0) for i, r in enumerate(rng.random((1200, 3)) * 4)], "pid long, x double, y double, z double, cls int, score double, normal_z double").repartition(4).cache()
    sizes, put = [], space.save

    def saved(df, *a):
        out = put(df, *a)
        sizes.append(out.count())
        return out

    for module in (space, neighbours):
        monkeypatch.setattr(module, "save", saved)
    jobs = {
        "scales": lambda: neighbours.multi_scale(cloud),
        "covariances": lambda: neighbours.nearest_covariances(None, cloud, 20),
        "normals": lambda: neighbours.nearest_normal_spread(cloud, 20),
        "outliers": lambda: neighbours.remove_outliers(cloud, 20),
        "planes": lambda: neighbours.plane_inliers(cloud),
        "growth": lambda: neighbours.region_grow(cloud, cloud.where("score >= 0.9")),
        "heights": lambda: neighbours.height_above_ground(cloud),
        "clusters": lambda: neighbours.dbscan(cloud, 0.25, 10),
    }
    assert jobs[job]().count()
    assert sizes and max(sizes) <= 1200


def test_cells_leave_one_link_each(spark, monkeypatch):
    """A dense cloud's cells are linked within blocks: what is saved of links follows the cells, not their pairs."""
    rng = np.random.default_rng(9)
    cloud = frame(spark, rng.random((4000, 3)) * 2)
    sizes, put = {}, neighbours.save

    def saved(df, name, *a):
        out = put(df, name, *a)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(neighbours, "save", saved)
    assert neighbours.dbscan(cloud, 0.4, 10).select("label").distinct().count() == 1
    assert sizes["pairs"] <= 3 * sizes["cells"]
