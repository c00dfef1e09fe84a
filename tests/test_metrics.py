import math
from datetime import datetime

import pytest

from thicket.operators import labels as lb
from thicket.operators import metrics as mx

TRUE = [[1, 2, 3], [3, 4, 7]]
RANKS = [[[1, 2, 4], [7, 6, 3]], [[1, 2], [7, 6, 3, 1]]]
TEXT_TRUE, TEXT_RANK = [["A", "B", "C"], ["C", "D", "G"]], [["A", "B", "D"], ["G", "F", "C"]]


def frame(spark, rows, kind="int"):
    return spark.createDataFrame(list(enumerate(rows)), f"row_id long, labels array<{kind}>")


def at(df, name):
    return [r[name] for r in df.orderBy("k").collect()]


@pytest.mark.parametrize("case", range(3))
def test_golden_values(spark, case):
    t, p = (frame(spark, TEXT_TRUE, "string"), frame(spark, TEXT_RANK, "string")) if case == 2 else (frame(spark, TRUE), frame(spark, RANKS[case]))
    assert at(mx.precision_at_k(t, p, 3), "precision") == pytest.approx([1, 3 / 4, 2 / 3])
    assert at(mx.recall_at_k(t, p, 3), "recall") == pytest.approx([1 / 3, 1 / 2, 2 / 3])
    assert at(mx.ndcg_at_k(t, p, 3), "ndcg") == pytest.approx([1, 0.8065736, 0.73463936])
    assert at(mx.dcg_at_k(t, p, 3), "dcg") == pytest.approx([1, 1 + 1 / math.log2(3) / 2, 1 + 1 / math.log2(3) / 2 + 0.25])
    assert at(mx.coverage_at_k(t, p, 3), "coverage") == pytest.approx([2 / 5, 3 / 5, 4 / 5])
    assert at(mx.abandonment_at_k(t, p, 3), "abandonment") == [1, 1, 1]
    if case != 1:
        assert mx.hamming_loss(t, p).first()[0] == 2
        assert mx.f1_measure(t, p, "micro").first()[0] == pytest.approx(2 / 3)
        assert mx.f1_measure(t, p, "samples").first()[0] == pytest.approx(2 / 3)
    if case == 0:  # labels 0..7: 1, 2, 3, 7 have F1 1, 1, 2/3... counted by hand: 1:1 2:1 3:2/3 4:0 6:0 7:1
        assert mx.macro_f1(t, p).first()[0] == pytest.approx((1 + 1 + 2 / 3 + 0 + 0 + 1) / 8)
        assert mx.macro_f1(t, p, zero_division=1).first()[0] == pytest.approx((1 + 1 + 2 / 3 + 0 + 0 + 1 + 2) / 8)


def test_propensity_scored_by_hand(spark):
    t, p = frame(spark, TRUE), frame(spark, RANKS[0])
    q = {1: 2.0, 2: 1.0, 3: 4.0, 7: 3.0, 6: 9.0}  # label 4 has none
    inv = spark.createDataFrame(list(q.items()), "label int, inv_ps double")
    hits = [[2, 1, 0], [3, 0, 4]]
    best = [[4, 2, 1], [4, 3, 0]]
    cum = lambda rows, w: [sum(sum(r[j] * w(j) for j in range(i + 1)) for r in rows) for i in range(3)]
    flat = [a / b for a, b in zip(cum(hits, lambda j: 1), cum(best, lambda j: 1))]
    assert at(mx.psprecision_at_k(t, p, inv, 3), "psprecision") == pytest.approx(flat)
    assert at(mx.psrecall_at_k(t, p, inv, 3), "psrecall") == pytest.approx(flat)
    log = lambda j: 1 / math.log2(j + 2)
    disc = [a / b for a, b in zip(cum(hits, log), cum(best, log))]
    assert at(mx.psdcg_at_k(t, p, inv, 3), "psdcg") == pytest.approx(disc)
    assert at(mx.psndcg_at_k(t, p, inv, 3), "psndcg") == pytest.approx(disc)
    plain = mx.psprecision_at_k(t, p, inv, 3, normalize=False)
    assert at(plain, "psprecision") == pytest.approx([v / 2 / (i + 1) for i, v in enumerate(cum(hits, lambda j: 1))])
    plain = mx.psdcg_at_k(t, p, inv, 3, normalize=False)
    assert at(plain, "psdcg") == pytest.approx([v / 2 / (i + 1) for i, v in enumerate(cum(hits, log))])


def test_empty_and_missing(spark):
    t, p = frame(spark, [[1], [], None]), frame(spark, [[1], [2]])
    assert at(mx.recall_at_k(t, p, 2, zero_division=1), "recall") == [1, 1]
    assert at(mx.recall_at_k(t, p, 2, semantics="cli"), "recall") == [1, 1]
    assert at(mx.precision_at_k(t, p, 1), "precision") == pytest.approx([1 / 3])
    assert mx.macro_f1(frame(spark, [[0, 1]]), frame(spark, [[1, 0]])).first()[0] == 1
    m = {r["metric"]: r["value"] for r in mx.cli_metrics(t, p, 1).collect()}
    assert m["r@1"] == 1 and m["p"] == 0.5 and m["acc"] == pytest.approx(1 / 3) and m["s"] == pytest.approx(2 / 3)


def test_macro_at_k_honours_k(spark):
    t, p = frame(spark, [[0, 1]]), frame(spark, [[1, 2, 0]])
    r = mx.macro_at_k(t, p, 3).orderBy("k").collect()
    assert [x["macro_precision"] for x in r] == pytest.approx([1 / 2, 1 / 3, 2 / 3])
    assert [x["macro_recall"] for x in r] == pytest.approx([1 / 2, 1 / 3, 2 / 3])


def test_label_statistics(spark):
    d = frame(spark, [[0, 0, 2], [2], None, [None]])
    assert {r["label"]: r["cnt"] for r in lb.count_labels(d).collect()} == {0: 1, 1: 0, 2: 2}
    assert {r["label"]: r["prior"] for r in lb.labels_priors(d).collect()} == {0: 0.25, 1: 0, 2: 0.5}
    assert {r["label"]: r["inv_prior"] for r in lb.inverse_labels_priors(d).collect()} == {0: 4, 1: math.inf, 2: 2}
    q = {r["label"]: r["inv_ps"] for r in lb.jain_inverse_propensity(d).collect()}
    assert q[2] == pytest.approx(1 + (math.log(4) - 1) * 2.5**0.55 * 3.5**-0.55)
    assert {r["label"]: r["ps"] for r in lb.jain_propensity(d).collect()}[2] == pytest.approx(1 / q[2])
    assert lb.propensity_parameters("Amazon-670K") == (0.6, 2.6) and lb.propensity_parameters("yeast") == (0.55, 1.5)
    assert lb.count_labels(d.limit(0)).count() == 0


def test_set_metrics_count_more_than_five_predictions(spark, tmp_path):
    from thicket.jobs.reference import queries

    true = {0: [0, 6, 8], 1: [7, 50], 2: [], 3: [1]}
    said = {(1, 0): range(8), (1, 1): range(300), (1, 2): [3], (2, 0): [9]}
    at = datetime(2024, 1, 1)
    points = [(i, y, [], at) for i, y in true.items()]
    spark.createDataFrame(points, "row_id long, labels array<int>, features array<struct<idx int, val double>>, loaded_at timestamp_ntz").write.parquet(f"{tmp_path}/data_points.parquet")
    scores = [(g, i, y, 1 / (1 + y), at) for (g, i), p in said.items() for y in p] + [(1, 9, 1, 0.5, at), (1, 0, 8, None, at)]
    spark.createDataFrame(scores, "run_id int, row_id long, label int, score double, scored_at timestamp_ntz").write.parquet(f"{tmp_path}/predictions.parquet")
    q = {n: {r["run_id"]: r[n] for r in queries()[n](spark, str(tmp_path)).collect()} for n in ("hamming_loss", "micro_f1", "samples_f1", "macro_f1")}
    assert q["hamming_loss"] == pytest.approx({1: (7 + 298 + 1) / 3, 2: 4.0}, abs=1e-6)
    assert q["micro_f1"] == pytest.approx({1: 8 / (11 + 302 + 1), 2: 0.0}, abs=1e-6)
    assert q["samples_f1"] == pytest.approx({1: (4 / 11 + 4 / 302) / 3, 2: 0.0}, abs=1e-6)
    assert q["macro_f1"] == pytest.approx({1: (2 / 3 + 2 / 3 + 2 / 3 + 0 + 1) / 300, 2: 0.0}, abs=1e-6)  # labels 0, 6, 7, 8, 50
    cli = {(r["run_id"], r["metric"]): r["value"] for r in queries()["cli_metrics"](spark, str(tmp_path)).collect()}
    assert [cli[1, m] for m in ("tp", "fp", "fn", "s", "hl")] == pytest.approx([4 / 3, 305 / 3, 1 / 3, 103, 102], abs=1e-6)
    assert cli[1, "p@3"] == pytest.approx(1 / 9, abs=1e-6)
