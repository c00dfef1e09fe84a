import random
from datetime import datetime, timedelta

import pytest

from thicket.operators.hierarchy import descendants, hierarchy

T0 = datetime(2024, 1, 1)
SCHEMA = "tree_id long, node_id int, parent_id int, children array<int>, label int, updated_at timestamp_ntz, path string, root int"


def frame(spark, rows):
    return spark.createDataFrame([(t, n, p, c, -1, T0 + timedelta(seconds=s) if s is not None else None, "x", 1) for t, n, p, c, s in rows], SCHEMA)


def brute(rows):
    best = {}
    for t, n, p, c, s in rows:
        if t is None or n is None:
            continue
        k = (s is not None, s or 0, p is not None, p or 0)
        if (t, n) not in best or k > best[t, n][0]:
            best[t, n] = (k, p, c)
    par = {}
    for (t, n), (_, p, _c) in best.items():
        if p is None:
            by = [m for (u, m), (_, _, c) in best.items() if u == t and n in (c or [])]
            p = min(by) if by else -1
        par[t, n] = p if (t, p) in best else None
    out = {}
    for t, n in par:
        path, x = [n], par[t, n]
        while x is not None and x not in path:
            path.append(x)
            x = par[t, x]
        if x is None:
            out[t, n] = (path[-1], path[::-1], "tree")
        else:
            out[t, n] = (-1, None, "cycle" if x == n else "below_cycle")
    return out


def check(spark, rows, split):
    h = hierarchy(frame(spark, rows), split).collect()
    got = {(r["tree_id"], r["node_id"]): (r["root_id"], r["path"], r["status"]) for r in h}
    assert len(h) == len(got)
    assert got == brute(rows)
    assert all(r["depth"] == (None if r["path"] is None else len(r["path"]) - 1) for r in h)


@pytest.mark.parametrize("split", [1, 3, 1000])
def test_random_forests(spark, split):
    rng = random.Random(split)
    rows = []
    for t in range(6):
        n = rng.choice([1, 2, 15, 60])
        for i in range(n):
            p = rng.choice([-1, None, 99, rng.randrange(n), max(i - 1, 0), i - 1])
            rows.append((t, i, p, [rng.randrange(n), None] if rng.random() < 0.3 else rng.choice([None, []]), rng.randrange(5)))
            if rng.random() < 0.2:
                rows.append(rows[-1])
    rows.append((None, 1, 1, None, 1))
    rows.append((7, None, 1, None, 1))
    check(spark, rows, split)


def test_chain_star_and_long_cycle(spark):
    rows = [(1, i, i - 1, None, 0) for i in range(200)]
    rows += [(2, 0, -1, None, 0)] + [(2, i, 0, None, 0) for i in range(1, 400)]
    rows += [(3, i, (i + 1) % 50, None, 0) for i in range(50)] + [(3, 50, 49, None, 0), (3, 60, 60, None, 0)]
    check(spark, rows, 4)
    check(spark, rows, 10**6)


def test_descendants_and_empty(spark):
    rows = [(1, 0, -1, None, 0), (1, 1, 0, None, 0), (1, 2, 1, None, 0)]
    d = {tuple(r) for r in descendants(hierarchy(frame(spark, rows))).collect()}
    assert d == {(1, 0, 1, 1), (1, 0, 2, 2), (1, 1, 2, 1)}
    assert hierarchy(frame(spark, rows).limit(0)).count() == 0


def test_roots_of_a_deep_chain(spark):
    rows = [(1, i, i - 1, None, 0) for i in range(3000)] + [(2, i, (i + 1) % 700, None, 0) for i in range(700)]
    got = {(r["tree_id"], r["node_id"]): (r["root_id"], r["depth"]) for r in hierarchy(frame(spark, rows)).collect()}
    assert got == {**{(1, i): (0, i) for i in range(3000)}, **{(2, i): (-1, None) for i in range(700)}}


@pytest.mark.parametrize("split", [1, 3, 1000])
def test_descendants_of_circles_and_below(spark, split):
    rng = random.Random(split)
    rows = [(1, i, (i + 1) % 40, None, 0) for i in range(40)] + [(1, 40 + i, 39 + i if i else 7, None, 0) for i in range(30)]
    rows += [(2, 5, 5, None, 0), (2, 6, 5, None, 0), (2, 7, 6, None, 0), (3, 0, -1, None, 0), (3, 1, 0, None, 0)]
    rows += [(4, i, rng.randrange(60), None, 0) for i in range(60)]
    par = {(t, n): p for t, n, p, _, _ in rows}
    want = set()
    for t, n in par:
        x, far, met = par[t, n], 1, {n}
        while x != -1 and x not in met:
            want.add((t, x, n, far))
            met.add(x)
            x, far = par[t, x], far + 1
    got = [tuple(r) for r in descendants(hierarchy(frame(spark, rows), split)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
