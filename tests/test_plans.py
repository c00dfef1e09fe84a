import random
from collections import defaultdict

from pyspark.sql import functions as F

from thicket.plans.graph import connected_components, resolve_pointers
from thicket.plans.ranking import top_positions
from thicket.plans.running import running_sums


def test_top_positions_over_partitions(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.7 else rng.randrange(50), rng.randrange(20), i) for i in range(3000)] + [(None, 5, i) for i in range(4000, 4020)]
    df = spark.createDataFrame(rows, "g int, s int, i int").repartition(7)
    for n in (1, 5, 900):
        got = defaultdict(list)
        for r in top_positions(df, ["g"], [F.col("s").desc(), F.col("i").asc()], n).collect():
            got[r["g"]].append((r["position"], r["s"], r["i"]))
        want = defaultdict(list)
        for g in {r[0] for r in rows}:
            own = sorted(((-s, i) for x, s, i in rows if x == g))[:n]
            want[g] = [(k + 1, -s, i) for k, (s, i) in enumerate(own)]
        assert {k: sorted(v) for k, v in got.items()} == want
    assert top_positions(df.limit(0), ["g"], [F.col("i")], 3).count() == 0


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [("a" if rng.random() < 0.6 else rng.choice("bcd"), i, rng.randrange(9)) for i in range(2000)]
    got = {r["i"]: r["running"] for r in running_sums(spark.createDataFrame(rows, "g string, i int, v long").repartition(5), "g", [F.col("i")], "v").collect()}
    total, want = defaultdict(int), {}
    for g, i, v in rows:
        total[g] += v
        want[i] = total[g]
    assert got == want


def test_stages_are_dropped(spark):
    from thicket.plans import stages

    root = stages.stage_root(spark)
    a, b = stages.write_stage(spark.range(3)), stages.write_stage(spark.range(4))
    assert b.count() == 4 and len(stages.list_path(spark, root)) >= 2
    stages.drop_stage(a)
    assert not stages.path_exists(spark, a._thicket_stage) and stages.path_exists(spark, b._thicket_stage)
    before = dict(stages._ROOTS)
    stages._ROOTS[spark.sparkContext.applicationId] = root + "-other"
    c = stages.write_stage(spark.range(2))
    stages.drop_stages(spark)
    assert not stages.path_exists(spark, c._thicket_stage) and spark.sparkContext.applicationId not in stages._ROOTS
    stages._ROOTS.update(before)


def test_pointers_and_components(spark):
    ptr = spark.createDataFrame([(i, max(i - 1, 0)) for i in range(100)] + [(200, 200)], "node long, to long")
    assert {r["node"]: r["end"] for r in resolve_pointers(ptr).collect()} == {**{i: 0 for i in range(100)}, 200: 200}
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(500, i) for i in range(501, 600)] + [(rng.randrange(700, 900), rng.randrange(700, 900)) for _ in range(120)] + [(5, 5)]
    comp = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for a, b in edges:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert comp == label
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
