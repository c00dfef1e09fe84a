import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from thicket.llm.cooccurrence import associations
from thicket.llm.ngrams import marked_terms, sequence_counts
from thicket.llm.queries import p7_found, p7_pairs
from thicket.llm.records import records
from thicket.llm.topn import top_n_per_group

T0 = datetime(2024, 1, 1)


def test_ngrams_against_brute_force(spark):
    rng = random.Random(5)
    docs = [[rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(80)] + [None, [], [1, None, 2], [3] * 300]
    got = sequence_counts(spark.createDataFrame([(x, 1) for x in docs], "s array<int>, item int").repartition(3), {"k": "s"}, 3).collect()
    occ, rec = Counter(), defaultdict(set)
    for i, x in enumerate(docs):
        x = [v for v in (x or []) if v is not None]
        for n in (1, 2, 3):
            for j in range(len(x) - n + 1):
                occ[tuple(x[j : j + n])] += 1
                rec[tuple(x[j : j + n])].add(i)
    assert {tuple(r["gram"]): (r["occurrences"], r["records"]) for r in got} == {k: (v, len(rec[k])) for k, v in occ.items()}


def test_marks_and_empty(spark):
    df = spark.createDataFrame([([1, 1, 2],), ([1],), ([1],), ([3],)] + [(None,)] * 36, "s array<int>")
    n = df.agg(F.count(F.lit(1)).alias("n"))
    m = {r["item"]: (r["occurrences"], r["records"], r["mark"]) for r in marked_terms(sequence_counts(df, {"k": "s"}), n).collect()}
    assert m == {1: (4, 3, "common"), 2: (1, 1, "rare"), 3: (1, 1, "rare")}
    assert marked_terms(sequence_counts(df.limit(0), {"k": "s"}), n).count() == 0


def _points(spark, rows):
    return spark.createDataFrame(
        [(i, 1, s, y, f, T0 + timedelta(seconds=t) if t is not None else None, 5) for i, s, y, f, t in rows],
        "row_id long, dataset_id int, subset string, labels array<int>, features array<struct<idx:int,val:double>>, loaded_at timestamp_ntz, rec int")


def test_records_take_the_newest_delivery(spark):
    rows = [(1, " Train", [3, 3, None, 1], [(2, 1.0), None, (None, 2.0), (2, 0.0)], 1), (1, "TEST ", [1], None, 2), (2, None, None, None, None), (None, "x", [1], None, 1)]
    r = {x["rec"]: x for x in records(_points(spark, rows), "labels", "features", "subset").collect()}
    assert set(r) == {1, 2}
    assert (r[1]["labels"], r[1]["features"], r[1]["subset"]) == ([1], [], "test")
    assert (r[2]["labels"], r[2]["subset"]) == ([], None)
    one = records(_points(spark, rows[:1]), "labels", "features").first()
    assert (one["labels"], one["features"]) == ([1, 3], [2])


def test_associations_against_brute_force(spark):
    rng = random.Random(6)
    baskets = [sorted({rng.randrange(12) for _ in range(rng.randrange(6))}) for _ in range(300)] + [[], list(range(100, 160))]
    got = {(r["label_a"], r["label_b"]): (r["n_ab"], r["n_a"], r["n_b"], round(r["lift"], 9)) for r in associations(spark.createDataFrame([(b,) for b in baskets], "items array<int>"), 2).collect()}
    c = Counter(x for b in baskets for x in b)
    p = Counter((a, b) for s in baskets for i, a in enumerate(s) for b in s[i + 1 :])
    want = {k: (v, c[k[0]], c[k[1]], round(v * len(baskets) / c[k[0]] / c[k[1]], 9)) for k, v in p.items() if min(c[k[0]], c[k[1]]) >= 2}
    assert got == want
    assert associations(spark.createDataFrame([], "items array<int>")).count() == 0


def test_pairs_of_rare_labels_are_kept_but_no_case(spark, tmp_path):
    rows = [(i, None, [1, 2] if i < 5 else [8, 9] if i == 5 else [], None, 1) for i in range(40)]
    _points(spark, rows).write.parquet(f"{tmp_path}/data_points.parquet")
    got = {(r["label_a"], r["label_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"], r["lift"]) for r in p7_pairs(spark, str(tmp_path)).collect()}
    assert got == {(1, 2): (5, 5, 5, 40, 8.0), (8, 9): (1, 1, 1, 40, 40.0)}
    assert [tuple(r) for r in p7_found(spark, str(tmp_path)).collect()] == [(1, 2)]


def test_cases_are_labels_together_in_five_records(spark, tmp_path):
    together = [[1, 2]] * 4 + [[3, 4]] * 5 + [[5, 6]] * 6  # 4, 5 and 6 times, at lifts of 5 or more
    alone = [[1], [2], [3], [4], [7], [7], [7], [7], [7, 8], [8], [8], [8], [8]]
    rows = [(i, None, y, None, 1) for i, y in enumerate(together + alone + [[]] * 12)]
    _points(spark, rows).write.parquet(f"{tmp_path}/data_points.parquet")
    pairs = {(r["label_a"], r["label_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in p7_pairs(spark, str(tmp_path)).collect()}
    assert pairs == {(1, 2): (4, 5, 5, 40), (3, 4): (5, 6, 6, 40), (5, 6): (6, 6, 6, 40), (7, 8): (1, 5, 5, 40)}
    assert {tuple(r) for r in p7_found(spark, str(tmp_path)).collect()} == {(3, 4), (5, 6)}


def test_top_n(spark):
    rows = [(1, 1, 7, 0.5, 1), (1, 1, 7, 0.9, 0), (1, 1, 8, 0.5, 1), (1, 1, 8, 0.5, 1), (1, 1, None, 9.0, 1), (1, 1, 9, None, 2), (1, 1, 9, 1.0, 1), (1, 1, 10, float("nan"), 1), (2, None, 1, 0.1, None)]
    rows += [(3, 5, i, (i % 11) / 10, 1) for i in range(500)]
    df = spark.createDataFrame([(r, i, y, s, T0 + timedelta(seconds=t) if t is not None else None, 1, 2) for r, i, y, s, t in rows], "run_id int, row_id long, label int, score double, scored_at timestamp_ntz, position int, _pid int")
    got = {(r["run_id"], r["row_id"], r["position"]): (r["label"], r["score"]) for r in top_n_per_group(df, 3).collect()}
    assert got == {(1, 1, 1): (7, 0.5), (1, 1, 2): (8, 0.5), (2, None, 1): (1, 0.1), (3, 5, 1): (10, 1.0), (3, 5, 2): (21, 1.0), (3, 5, 3): (32, 1.0)}
    assert top_n_per_group(df.limit(0)).count() == 0
