import math
import random

import pytest

from thicket.llm import density
from thicket.llm.density import density_clusters, describe_clusters
from thicket.llm.overlap import band_top, expand_pairs, max_difference, overlap_report, similar_across


def test_difference_bound_holds():
    for m in range(5, 60):
        top = next(band_top(i, 5, 0.8) for i in range(60) if band_top(i, 5, 0.8) >= m)
        low = next(i for i in range(60) if band_top(i, 5, 0.8) >= m)
        assert max_difference(m, 0.8, 5) <= max(max_difference(x, 0.8, 5) for x in range(5, top + 1))
        for b in range(max(5, math.ceil(0.8 * m)), m + 1):
            assert low - next(i for i in range(60) if band_top(i, 5, 0.8) >= b) <= 1
            for common in range(b + 1):
                if common >= 0.8 * (m + b - common) - 1e-9:
                    assert m + b - 2 * common <= max_difference(m, 0.8, 5)


@pytest.mark.parametrize("size", [(5, 12), (20, 45), (300, 420)])
def test_overlap_against_brute_force(spark, size):
    rng = random.Random(size[0])
    base = [set(rng.sample(range(3000), rng.randrange(*size))) for _ in range(25)]
    recs = []
    for i in range(240):
        s = set(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, len(s) // 10, len(s) // 5])):
            s.discard(rng.choice(sorted(s))) if rng.random() < 0.5 else s.add(rng.randrange(3000))
        recs.append((i, rng.choice([0, 0, 1, None]), sorted(s)))
    recs += [(900, 0, []), (901, 1, []), (902, 0, [1, 2, 3, 4]), (903, 1, [1, 2, 3, 4]), (904, 1, None)]
    df = spark.createDataFrame(recs, "rec long, side int, items array<int>")
    p, m = similar_across(df)
    got = {(r["rec_0"], r["rec_1"]) for r in expand_pairs(p, m).collect()}
    want = set()
    for a, sa, x in recs:
        for b, sb, y in recs:
            if sa == 0 and sb == 1 and len(x or []) >= 5 and len(y or []) >= 5:
                c = len(set(x) & set(y))
                if 5 * c >= 4 * (len(x) + len(y) - c):
                    want.add((a, b))
    assert got == want and want
    rep = overlap_report(p, m, spark.createDataFrame([(r[0], "test", 1) for r in recs], "rec long, subset string, dataset_id int")).first()
    assert rep["exact"] + rep["near"] == len({b for _, b in want})


def test_overlap_hot_copies_and_empty(spark):
    rows = [(i, i % 2, [1, 2, 3, 4, 5, 6]) for i in range(400)]
    p, m = similar_across(spark.createDataFrame(rows, "rec long, side int, items array<int>"))
    assert p.count() == 1 and m.count() == 400
    p, m = similar_across(spark.createDataFrame([], "rec long, side int, items array<int>"))
    assert p.count() == 0 and m.count() == 0


def _units(points):
    vec = {}
    for p, v in points:
        if p is None:
            continue
        d = {}
        for e in v or []:
            if e and e[0] is not None and e[1] is not None and math.isfinite(e[1]) and e[1] != 0:
                d[e[0]] = max(d.get(e[0], -math.inf), e[1])
        if d:
            n = math.sqrt(sum(x * x for x in d.values()))
            vec[p] = {k: x / n for k, x in d.items()}
    return vec


def _brute(points):
    vec = _units(points)
    near = {a: [b for b in vec if b != a and sum(x * vec[b].get(k, 0) for k, x in vec[a].items()) >= 0.9] for a in vec}
    lab = {a: a for a in vec}
    while True:
        new = {a: min([lab[a], *(lab[b] for b in near[a])]) for a in vec}
        if new == lab:
            return {a: (lab[a], len(near[a])) for a in vec if near[a]}
        lab = new


@pytest.mark.parametrize("tile,dense,near", [(1024, 2_000_000, 8), (7, 40, 2), (1024, -1, 1)])
def test_clusters_against_brute_force(spark, monkeypatch, tile, dense, near):
    monkeypatch.setattr(density, "TILE", tile)
    monkeypatch.setattr(density, "DENSE", dense)
    monkeypatch.setattr(density, "NEAR", near)
    rng = random.Random(8)
    pts = []
    for c in range(14):
        dims = rng.sample(range(40), rng.choice([1, 2, 6, 10]))
        center = {d: rng.gauss(0, 1) * (6 if i == 0 and c % 3 == 0 else 1) for i, d in enumerate(dims)}
        for _ in range(rng.choice([1, 3, 25])):
            v = [(d, x + rng.gauss(0, 0.25 * abs(x) + 0.05)) for d, x in center.items()] + [(rng.randrange(40, 60), rng.gauss(0, 0.1)) for _ in range(2)]
            rng.shuffle(v)
            pts.append((len(pts), [(d, x * 3) for d, x in dict(v).items()]))
    pts += [(500, None), (501, []), (502, [(1, 0.0), (2, None), None]), (None, [(1, 1.0)]), (503, [(1, float("nan"))]), (504, [(3, 2.0)]), (505, [(3, 9.0)]), (506, [(3, -9.0)]), (504, [(3, 2.0)])]
    df = spark.createDataFrame([(p, v, 0.5, 1) for p, v in pts], "point_idx long, sim_values array<struct<idx:int,val:double>>, sortby double, cluster_idx int")
    got = density_clusters(df)
    rows = got.collect()
    assert {r["point_idx"]: (r["cluster_idx"], r["density"]) for r in rows} == _brute(pts)
    rank = {r["point_idx"]: (r["density"], -r["point_idx"]) for r in rows}
    vec = _units(pts)
    for r in rows:  # the nearest of all denser neighbours
        p = r["point_idx"]
        cos = {q: sum(x * vec[q].get(k, 0) for k, x in vec[p].items()) for q in rank if rank[q] > rank[p]}
        best = max((c for c in cos.values() if c >= 0.9), default=None)
        assert (r["uphill"] is None) == (best is None)
        assert best is None or (cos[r["uphill"]] == pytest.approx(best) and r["cosine"] == pytest.approx(best))
    info = describe_clusters(got, 2).collect()
    assert sum(r["size"] for r in info) == len(rows)
    for r in info:
        own = sorted((x for x in rows if x["cluster_idx"] == r["cluster_idx"]), key=lambda x: (-x["density"], x["point_idx"]))
        assert r["typical"] == [x["point_idx"] for x in own[:2]]


def test_clusters_of_copies(spark):
    pts = [(i, [(1, 1.0 + i % 3), (2, 2.0 * (1 + i % 3))]) for i in range(900)] + [(1000, [(1, 1.0), (2, 2.1)]), (1001, [(7, 1.0)]), (1002, [(7, 1.0)])]
    got = density_clusters(spark.createDataFrame(pts, "point_idx long, sim_values array<struct<idx:int,val:double>>")).collect()
    assert {r["point_idx"]: (r["cluster_idx"], r["density"]) for r in got} == {**{i: (0, 900) for i in [*range(900), 1000]}, 1001: (1001, 1), 1002: (1001, 1)}
    assert sum(r["uphill"] is None for r in got) == 2 and all(r["peak"] in (0, 1001) for r in got)


def test_clusters_empty(spark):
    df = spark.createDataFrame([], "point_idx long, sim_values array<struct<idx:int,val:double>>")
    assert density_clusters(df).count() == 0
