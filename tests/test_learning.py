import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.models import BR, HSM, MACH, OPLT, OVR, PLT, XT, Model
from thicket.operators import linear, predict
from thicket.operators import metrics as mx
from thicket.operators.extreme_text import predict_embedding_tree, train_embedding_tree
from thicket.operators.train import TrainOptions, train_loss, train_problems
from thicket.plans.stages import write_stage
from thicket.operators.trees import check_tree
from thicket.streaming import ofo
from thicket.streaming.online_plt import OnlineOptions, OnlinePLT, advance, fit_stream, last_state, state_tables

RNG = np.random.default_rng(0)


def csr(n=200, m=12):
    x = RNG.normal(size=(n, m)) * (RNG.random((n, m)) < 0.6)
    x[:, 0] = 1
    y = (x @ RNG.normal(size=m) + RNG.normal(size=n) > 0).astype(float)
    r, c = np.nonzero(x)
    return linear.Csr(c, x[r, c], np.bincount(r, minlength=n)), x, y


@pytest.mark.parametrize("solver", ["L2R_LR_DUAL", "L2R_LR", "L2R_L2LOSS_SVC_DUAL", "L2R_L2LOSS_SVC"])
def test_smooth_solvers_reach_the_optimum(solver):
    c, x, y = csr()
    _, w, count, _ = linear.train_binary(c, y, solver=solver, cost=1.0, eps=1e-5, max_iter=2000, weights_threshold=0)
    s = 2 * y - 1
    z = s * (x[:, c.cols] @ w)
    d = -1 / (1 + np.exp(z)) if "LR" in solver else -2 * np.maximum(0, 1 - z)
    g = w + x[:, c.cols].T @ (s * d)
    assert count == 2 and np.abs(g).max() < 0.02


@pytest.mark.parametrize("solver", ["L1R_LR", "L1R_L2LOSS_SVC"])
def test_l1_solvers_meet_the_optimality_conditions(solver):
    c, x, y = csr()
    w = np.zeros(len(c.cols))
    cols, v, *_ = linear.train_binary(c, y, solver=solver, cost=0.3, eps=1e-4, max_iter=500, weights_threshold=0)
    w[np.searchsorted(c.cols, cols)] = v
    s = 2 * y - 1
    z = s * (x[:, c.cols] @ w)
    g = x[:, c.cols].T @ (0.3 * s * (-1 / (1 + np.exp(z)) if solver == "L1R_LR" else -2 * np.maximum(0, 1 - z)))
    assert np.all(np.abs(g[w == 0]) <= 1.02) and np.allclose(g[w != 0], -np.sign(w[w != 0]), atol=0.03)


def test_hinge_dual_and_special_cases():
    c, x, y = csr()
    _, w, *_ = linear.train_binary(c, y, solver="L2R_L1LOSS_SVC_DUAL", cost=1.0, eps=1e-4, max_iter=3000, weights_threshold=0)
    s = 2 * y - 1
    obj = lambda w: 0.5 * w @ w + np.maximum(0, 1 - s * (x[:, c.cols] @ w)).sum()
    assert all(obj(w) <= obj(w + d) + 1e-2 for d in RNG.normal(size=(200, len(w))) * 0.05)
    assert linear.train_binary(c, np.ones(c.n))[2:] == (1, 1) and linear.train_binary(c, np.zeros(c.n))[2:] == (1, 0)
    assert linear.train_binary(linear.Csr(np.zeros(0, int), np.zeros(0), np.zeros(0, int)), [])[2] == 0
    with pytest.raises(ValueError):
        linear.train_binary(c, y, solver="none")
    for opt in ("sgd", "adagrad"):
        _, w, *_ = linear.train_binary(c, y, optimizer=opt, epochs=5, weights_threshold=0)
        assert ((x[:, c.cols] @ w > 0) == (y == 1)).mean() > 0.75


def blobs(spark, n=240, k=6, seed=1):
    rng = np.random.default_rng(seed)
    cent = rng.normal(size=(k, 10)) * 2
    lab = rng.integers(0, k, n)
    x = cent[lab] + rng.normal(size=(n, 10)) * 0.7
    y = [[int(a), int((a + 1) % k)] if a == 0 else [int(a)] for a in lab]
    return x, y


def p_at_1(spark, y, pred):
    t = spark.createDataFrame(list(enumerate(y)), "row_id long, labels array<int>")
    return mx.precision_at_k(t, pred, 1).first()["precision"]


@pytest.mark.parametrize("make", [
    lambda s: PLT(s, tree_type="completeKaryInOrder"), lambda s: PLT(s, tree_type="huffman", optimizer="adagrad", epochs=3), lambda s: PLT(s, max_leaves=2),
    lambda s: HSM(s, tree_type="completeKaryInOrder", arity=3), lambda s: BR(s), lambda s: OVR(s, loss="logistic"), lambda s: BR(s, loss="squaredHinge"), lambda s: MACH(s, hashes=4, buckets=5)])
def test_models_learn(spark, make):
    x, y = blobs(spark)
    m = make(spark).fit(x, y)
    assert p_at_1(spark, y, m.predict(x, top_k=3)) > 0.85


def test_plt_searches_agree_and_reload(spark, tmp_path):
    x, y = blobs(spark)
    m = PLT(spark, tree_type="balancedInOrder", max_leaves=2, weights_threshold=0.0).fit(x, y)
    norm = lambda df: {(r["row_id"], r["label"]): round(r["score"], 9) for r in df.collect()}
    exact = norm(m.predict_proba(x, top_k=2))
    tree, models, weights = m.members[0]
    rows = m._rows(x)
    assert norm(predict.top_k(predict.plt_scores(rows, tree, models, weights), 2)) == exact
    assert norm(predict.plt_beam(rows, tree, models, weights, 2, width=50)) == exact
    m.save(str(tmp_path / "m"))
    assert norm(Model.load(spark, str(tmp_path / "m")).predict_proba(x, top_k=2)) == exact
    assert {tuple(r) for r in Model.preload_tree(spark, str(tmp_path / "m")).collect()} == {tuple(r) for r in tree.collect()}
    again = PLT(spark, tree_type="balancedInOrder", max_leaves=2, weights_threshold=0.0).fit(x, y)
    assert norm(again.predict_proba(x, top_k=2)) == exact
    t = 0.3
    assert norm(m.predict_proba(x, top_k=0, threshold=t)) == {k: v for k, v in norm(m.predict_proba(x, top_k=0)).items() if v >= t}
    w = spark.createDataFrame([(0, 0.0), (3, 2.0)], "label int, weight double")
    full = norm(m.predict_proba(x, top_k=0))
    assert norm(m.predict_proba(x, top_k=0, labels_weights=w))[0, 3] == pytest.approx(2 * full[0, 3])
    pairs = spark.createDataFrame([(0, 1), (1, 99)], "row_id long, label int")
    assert {(r["row_id"], r["label"]): round(r["score"], 9) for r in predict.predict_for_label(rows, pairs, tree, models, weights).collect()} == {(0, 1): full[0, 1], (1, 99): 0}
    ens = PLT(spark, ensemble=2, tree_type="completeKaryRandom").fit(x, y)
    assert p_at_1(spark, y, ens.predict(x)) > 0.85
    triples = [(r["parent_id"], r["node_id"], r["label"]) for r in m.get_tree_structure().collect()]
    own = PLT(spark)
    own.set_tree_structure(triples)
    own.fit(x, y)
    assert {tuple(r) for r in own.get_tree_structure().collect()} == set(triples)
    assert own.get_nodes_to_update(y).select("row_id").distinct().count() == len(y)
    assert own.get_nodes_updates(y).select("node_id").distinct().count() == len(triples)
    with pytest.raises(TypeError):
        PLT(spark, nonsense=1)


def test_containers(spark):
    from types import SimpleNamespace

    from thicket.sources.adapters import features_frame, labels_frame, to_csr, to_np_matrix

    dense = np.array([[0, 1.5], [2, 0]])
    want = [[(1, 1.5)], [(0, 2.0)]]
    csr_like = SimpleNamespace(indptr=[0, 1, 2], indices=[1, 0], data=[1.5, 2.0])
    for x in (dense, dense.astype(np.float32), csr_like, [[(1, 1.5)], [(0, 2.0)]]):
        assert [[tuple(e) for e in r["features"]] for r in features_frame(spark, x).orderBy("row_id").collect()] == want
    for y in ([1, 0], [[1], [0]], np.array([1, 0]), np.array([1.0, 0.0]), np.array([[0, 1], [1, 0]]), csr_like, [[(1, 1.0)], [(0, 1.0)]]):
        assert [r["labels"] for r in labels_frame(spark, y).orderBy("row_id").collect()] == [[1], [0]]
    with pytest.raises(ValueError):
        features_frame(spark, np.zeros((1, 1, 1)))
    with pytest.raises(ValueError):
        labels_frame(spark, np.zeros((1, 1, 1)))
    assert [r["indptr"] for r in to_csr(features_frame(spark, dense)).orderBy("row_id").collect()] == [0, 1]
    assert (to_np_matrix(features_frame(spark, dense), 2) == dense).all()
    with pytest.raises(ValueError):
        to_np_matrix(features_frame(spark, dense), 2, most_cells=3)


def test_big_problems_are_trained_by_the_distributed_solver(spark):
    x, y = blobs(spark, 150, 2)
    rows = spark.createDataFrame([(i, [(-1, 1.0)] + [(j, float(v)) for j, v in enumerate(r)]) for i, r in enumerate(x)], "row_id long, features array<struct<idx:int,val:double>>")
    a = spark.createDataFrame([(0, i, int(v[0] == 0)) for i, v in enumerate(y)] + [(1, i, 1) for i in range(9)], "node_id int, row_id long, y int")
    o = TrainOptions(solver="L2R_LR", cost=1.0, eps=1e-6, max_iter=500, weights_threshold=0.0)
    small, big = train_problems(a, rows, o), train_problems(a, rows, o, big_rows=10)
    w = [{r["idx"]: r["w"] for r in k[1].collect()} for k in (small, big)]
    assert w[0].keys() == w[1].keys() and all(abs(w[0][i] - w[1][i]) < 0.02 for i in w[0])
    assert {r["node_id"]: r["class_count"] for r in big[0].collect()} == {0: 2, 1: 1}
    assert train_loss(small[0]).first()["mean_loss"] >= 0


def test_one_vs_rest_blocks_and_distributed_agree(spark):
    from thicket.operators.train import train_one_vs_rest

    x, y = blobs(spark, 120, 3)
    y[0], y[1] = [], [0, 2]
    d = spark.createDataFrame([(i, y[i] + [7], [(-1, 1.0)] + [(j, float(v)) for j, v in enumerate(r)]) for i, r in enumerate(x)], "row_id long, labels array<int>, features array<struct<idx:int,val:double>>")
    o = TrainOptions(solver="L2R_LR", cost=1.0, eps=1e-6, max_iter=500, weights_threshold=0.0)
    got = []
    for kw in ({"block": 64}, {"block": 1}, {"big_rows": 10}):
        m, w = train_one_vs_rest(d, o, **kw)
        assert {r["node_id"]: r["class_count"] for r in m.collect()} == {0: 2, 1: 2, 2: 2, 7: 1}
        got.append({(r["node_id"], r["idx"]): r["w"] for r in w.collect()})
    assert got[0] == pytest.approx(got[1]) and got[0].keys() == got[2].keys() and all(abs(got[0][k] - got[2][k]) < 0.02 for k in got[0])


def test_block_scores_equal_the_join(spark, monkeypatch):
    x, y = blobs(spark, 60, 4)
    rows = spark.createDataFrame([(i, [(j, float(v)) for j, v in enumerate(r) if j % 2 == i % 2]) for i, r in enumerate(x)] + [(99, []), (100, [(500, 1.0)])], "row_id long, features array<struct<idx:int,val:double>>")
    w = spark.createDataFrame([(n, j, float((n * 7 + j) % 5 - 2)) for n in range(5) for j in range(9) if (n + j) % 3], "node_id int, idx int, w double")
    m = spark.createDataFrame([(0, 2, 1), (1, 2, 0), (2, 1, 1), (3, 1, 0), (4, 0, 0)], "node_id int, class_count int, first_class int")
    norm = lambda df, c: {(r["row_id"], r[c]): round(r[-1], 9) for r in df.collect()}
    fast = norm(predict.all_values(rows, m, w), "node_id"), norm(predict.br_predict(rows, m, w, 2, loss="squaredHinge"), "label"), norm(predict.ovr_predict(rows, m, w, 3), "label")
    monkeypatch.setattr(predict, "SMALL_MODEL", -1)
    monkeypatch.setattr(predict, "BLOCK_WEIGHTS", 9)
    monkeypatch.setattr(predict, "CHUNK_CELLS", 100)
    slow = norm(predict.all_values(rows, m, w), "node_id"), norm(predict.br_predict(rows, m, w, 2, loss="squaredHinge"), "label"), norm(predict.ovr_predict(rows, m, w, 3), "label")
    assert fast == slow and len(fast[0]) == 62 * 5


def test_tree_searches_equal_full_scoring(spark, monkeypatch):
    """Exact and beam search with every kind of label term, broadcast and by parts, against products over all nodes."""
    rng = np.random.default_rng(4)
    from thicket.operators.trees import complete_tree

    rows = spark.createDataFrame([(i, [(int(j), float(rng.normal())) for j in np.sort(rng.choice(12, 5, replace=False))]) for i in range(40)] + [(99, [])], "row_id long, features array<struct<idx:int,val:double>>")
    norm = lambda df: {(r["row_id"], r["label"]): round(r["score"], 9) for r in df.collect()}

    def best(scores, k):
        out = {}
        for r in {r for r, _ in scores}:
            own = sorted(((-v, lab) for (x, lab), v in scores.items() if x == r))[:k]
            out.update({(r, lab): -v for v, lab in own})
        return out

    tree = write_stage(complete_tree(spark, 23, 3), "tree")
    ids = [r["node_id"] for r in tree.collect()]
    w = spark.createDataFrame([(n, j, float(rng.normal())) for n in ids for j in range(12) if rng.random() < 0.6], "node_id int, idx int, w double")
    m = spark.createDataFrame([(n, 2 - (n % 7 == 6), int(n % 5 > 0)) for n in ids if n != 4], "node_id int, class_count int, first_class int")
    weight, bias, limit = {i: float(rng.choice([-1, 0.5, 2, 3])) for i in range(0, 19, 2)}, {i: float(rng.normal() / 10) for i in range(0, 19, 3)}, {i: 0.02 * (i % 4) for i in range(0, 19, 2)}
    lw, lb, lt = (spark.createDataFrame(list(d.items()), f"label int, {n} double") for d, n in ((weight, "weight"), (bias, "bias"), (limit, "threshold")))
    want = norm(predict.plt_scores(rows, tree, m, w))
    termed = best({(r, lab): round(v * weight.get(lab, 1) + bias.get(lab, 0), 9) for (r, lab), v in want.items() if v >= limit.get(lab, 0.01)}, 4)
    hsm = beam = None
    for small in (10**6, -1):
        monkeypatch.setattr(predict, "SMALL_MODEL", small)
        monkeypatch.setattr(predict, "BLOCK_WEIGHTS", 40)
        monkeypatch.setattr(predict, "CHUNK_CELLS", 60)
        assert norm(predict.plt_predict(rows, tree, m, w, 3)) == best(want, 3)
        assert norm(predict.plt_predict(rows, tree, m, w, 0, 0.05)) == {k: v for k, v in want.items() if v >= 0.05}
        assert norm(predict.plt_predict(rows, tree, m, w, 4, 0.01, lt, lw, lb)) == pytest.approx(termed)
        narrow, every = norm(predict.plt_beam(rows, tree, m, w, 3, width=2)), norm(predict.hsm_predict(rows, tree, m, w, 0))
        if hsm is None:
            hsm, beam = every, narrow
            assert narrow != best(want, 3) and set(narrow.items()) <= set(want.items())
            assert norm(predict.plt_beam(rows, tree, m, w, 3, width=50)) == best(want, 3)
            evaluated = [r["evaluated"] for r in predict.evaluated_nodes(rows, tree, m, w, 1).collect()]
            assert len(evaluated) == 41 and all(0 < e <= 2 * len(ids) for e in evaluated) and min(evaluated) < len(ids)
            pairs = spark.createDataFrame([(r, lab) for r in (0, 7, 99) for lab in (0, 5, 77)], "row_id long, label int")
            assert norm(predict.hsm_predict_for_label(rows, pairs, tree, m, w)) == {(r, lab): hsm.get((r, lab), 0) for r in (0, 7, 99) for lab in (0, 5, 77)}
        assert every == hsm and narrow == beam and norm(predict.hsm_predict(rows, tree, m, w, 2)) == best(hsm, 2)


def test_ofo(spark):
    rows = spark.createDataFrame([(0, [1], [(1, 0.9), (2, 0.6)]), (1, [2], [(1, 0.2), (2, 0.4)]), (2, None, None)], "row_id long, labels array<int>, probs array<struct<label:int,score:double>>")
    # thresholds by hand: 10/20 -> both of row 0 predicted: 11/23; row 1: none, 11/24
    assert ofo.micro_ofo(rows) == pytest.approx(11 / 24)
    m = {r["label"]: r["threshold"] for r in ofo.macro_ofo(rows).collect()}
    assert m == pytest.approx({1: 11 / 22, 2: 10 / 22})
    pri = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.0)], "label int, prior double")
    mixed = {r["label"]: r["threshold"] for r in ofo.mixed_ofo(rows, pri, top=1).collect()}
    assert mixed == pytest.approx({1: 11 / 22, 2: 11 / 24, 3: 11 / 24})
    long = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.6, 0), (1, 1, 0.2, 0), (1, 2, 0.4, 1)], "row_id long, label int, score double, y int")
    blocks = spark.createDataFrame([(0, 0), (1, 1)], "row_id long, block int")
    assert {r["label"]: r["threshold"] for r in ofo.macro_ofo_blocks(long, blocks, 2).collect()} == pytest.approx(m)


@pytest.mark.parametrize("policy", ["onlineBestScore", "onlineRandom"])
def test_online_tree_learns_from_a_stream(spark, tmp_path, policy):
    x, y = blobs(spark, 300)
    d = spark.createDataFrame([(i, y[i], [(-1, 1.0)] + [(j, float(v)) for j, v in enumerate(r)]) for i, r in enumerate(x)], "row_id long, labels array<int>, features array<struct<idx:int,val:double>>")
    src, ck, o = str(tmp_path / "in"), str(tmp_path / "ck"), OnlineOptions(policy=policy, max_leaves=2)
    d.repartitionByRange(3, "row_id").write.parquet(src)
    fit_stream(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 2).parquet(src), ck, o).awaitTermination()
    batch, state = last_state(spark, ck)
    assert batch == 1 and last_state(spark, str(tmp_path / "none")) == (-1, None)
    halves = OnlinePLT.of_state(advance(d.filter("row_id >= 150"), o, advance(d.filter("row_id < 150"), o)))
    plain = OnlinePLT(o).fit_batch(d)  # the same rows through one iterator on the driver
    assert halves.parent == plain.parent and [m.w for m in halves.base] == [m.w for m in plain.base]
    more = advance(d, o, state, 2)
    tree, models, weights = state_tables(more)
    check_tree(tree)
    assert {r["label"] for r in tree.collect() if r["label"] >= 0} == set(range(6))
    pred = mx.from_scores(predict.tree_search(d.select("row_id", "features"), tree, models, weights, 3))
    assert p_at_1(spark, y, pred) > 0.6
    again = OnlinePLT.of_state(more).fit_batch(d.limit(0))
    assert sorted(map(tuple, again.state(spark).select("node_id", "line").collect())) == sorted(map(tuple, more.select("node_id", "line").collect()))
    whole = OnlinePLT.of_state(advance(d, o, None, 2))
    assert whole.parent == OnlinePLT(o).fit_batch(d, 2).parent and whole.base[2].w == OnlinePLT(o).fit_batch(d, 2).base[2].w
    assert advance(d.limit(0), o).filter("node_id >= 0").count() == 0
    warm = OnlinePLT.warm_start(tree, weights).fit_batch(d.limit(20))
    assert warm.parent == again.parent
    with pytest.raises(ValueError):
        OnlineOptions(policy="other")


def test_embedding_tree(spark):
    from thicket.operators.trees import complete_tree

    x, y = blobs(spark, 300, 4)
    d = spark.createDataFrame([(i, y[i], [(j, float(abs(v))) if v >= 0 else (j + 10, float(abs(v))) for j, v in enumerate(r)]) for i, r in enumerate(x)], "row_id long, labels array<int>, features array<struct<idx:int,val:double>>")
    t = complete_tree(spark, 4, 2)
    i, o = train_embedding_tree(d, t, dims=8, epochs=8, eta=0.5, shards=2)
    pred = mx.from_scores(predict_embedding_tree(d.select("row_id", "features"), t, i, o, 2))
    assert p_at_1(spark, y, pred) > 0.7


def test_hsm_scores_sum_to_the_root(spark):
    x, y = blobs(spark, 120, 5)
    m = HSM(spark, tree_type="completeKaryInOrder", arity=3).fit(x, y)
    s = m.predict_proba(x, top_k=0).groupBy("row_id").agg(F.sum("score").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1 / (1 + np.exp(-10)), abs=1e-9) for r in s)


def test_streamed_precision_equals_batch(spark, tmp_path):
    from thicket.streaming.metrics import precision_stream, read_result

    x, y = blobs(spark, 80, 4)
    truth = spark.createDataFrame(list(enumerate(y)), "row_id long, labels array<int>")
    pred = spark.createDataFrame([(i, [i % 4, (i + 1) % 4]) for i in range(80)], "row_id long, labels array<int>")
    pred.repartition(5).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(pred.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "p"))
    got = {r["k"]: r["precision"] for r in read_result(precision_stream(stream, truth, 2)).collect()}
    assert got == {r["k"]: round(r["precision"], 6) for r in mx.precision_at_k(truth, pred, 2).collect()}


@pytest.mark.parametrize("kind", [PLT, BR])
def test_ensemble_scores_labels_that_a_member_lacks(spark, kind):
    rng = np.random.default_rng(3)
    x = spark.createDataFrame([(i, [(j, float(v)) for j, v in enumerate(rng.normal(size=6))]) for i in range(60)], "row_id long, features array<struct<idx int, val double>>")
    y = spark.createDataFrame([(i, [i % 7]) for i in range(60)], "row_id long, labels array<int>")
    m = kind(spark, ensemble=2, **({"tree_type": "completeKaryRandom"} if kind is PLT else {})).fit(x, y)
    if kind is BR:  # members that disagree
        m.members[1] = (None, m.members[1][1], m.members[1][2].withColumn("w", -F.col("w")))
    rows, members = m._rows(x), []
    for e in m.members:
        members.append({(r["row_id"], r["label"]): r["score"] for r in m._predict_member(rows, e, 0, 0.0, (None, None)).collect()})
    best = lambda a, i: sorted(range(7), key=lambda c: (-a[i, c], c))[:2]
    for fill in (True, False):
        want = {}
        for i in range(60):
            tops = [best(a, i) for a in members]
            s = {c: sum(a[i, c] for a, t in zip(members, tops) if fill or c in t) / 2 for c in {*tops[0], *tops[1]}}
            want.update({(i, c): s[c] for c in sorted(s, key=lambda c: (-s[c], c))[:2]})
        got = {(r["row_id"], r["label"]): r["score"] for r in m.set_params(ens_missing_scores=fill).predict_proba(x, top_k=2).collect()}
        assert got == pytest.approx(want)


@pytest.mark.parametrize("kw", [
    {"solver": "L2R_LR_DUAL"}, {"solver": "L2R_L2LOSS_SVC_DUAL", "loss": "squaredHinge"}, {"solver": "L2R_L1LOSS_SVC_DUAL"}, {"solver": "L1R_LR"}, {"solver": "L1R_L2LOSS_SVC"},
    {"solver": "L2R_LR", "imbalance": True, "auto_c": "log"}, {"optimizer": "adagrad", "epochs": 2}, {"optimizer": "sgd", "l2": 0.01}])
def test_large_problems_meet_the_optimum_of_small_ones(spark, kw):
    """Two tree problems with own rows and one-vs-rest labels, below and above the switch, for every solver."""
    from thicket.operators.train import train_one_vs_rest

    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(90, 5)), 3)
    x[:, 0] = 1
    side = x @ rng.normal(size=5) + rng.normal(size=90)
    d = spark.createDataFrame([(i, [int(v > 0.7), 2] if i % 3 else [int(v > 0.7)], [(j - 1, float(e)) for j, e in enumerate(r)]) for i, (r, v) in enumerate(zip(x, side))], "row_id long, labels array<int>, features array<struct<idx:int,val:double>>")
    a = d.select(F.lit(7).alias("node_id"), "row_id", F.col("labels")[0].alias("y")).unionByName(d.filter("row_id < 60").select(F.lit(3).alias("node_id"), "row_id", (1 - F.col("labels")[0]).alias("y")))
    tight = {"cost": 0.5, "eps": 1e-3 if kw.get("solver") != "L2R_L1LOSS_SVC_DUAL" else 0.05, "max_iter": 3000 if "L1LOSS" not in kw.get("solver", "") else 30, "weights_threshold": 0.0, **kw}

    def objective(w, rows, y, cost):
        z = (2 * y - 1) * (x[rows] @ w)
        loss = np.logaddexp(0, -z) if "LR" in kw["solver"] else np.maximum(0, 1 - z) ** (2 if "L2LOSS" in kw["solver"] else 1)
        return (np.abs(w).sum() if kw["solver"].startswith("L1R") else 0.5 * w @ w) + cost * loss.sum()

    got = []
    for big in (10**6, 10):
        for m, w in (train_problems(a, d.select("row_id", "features"), TrainOptions(**tight), big), train_one_vs_rest(d, TrainOptions(**tight), big_rows=big)):
            vec = {}
            for r in w.collect():
                vec.setdefault(r["node_id"], np.zeros(5))[r["idx"] + 1] = r["w"]
            got.append((vec, {r["node_id"]: (r["class_count"], round(r["loss"], 3), r["n"]) for r in m.collect()}))
    for small, large in (got[0], got[2]), (got[1], got[3]):
        assert small[0].keys() == large[0].keys() and small[1].keys() == large[1].keys()
        if "optimizer" in kw:
            assert small[1] == large[1] and all((small[0][n] == large[0][n]).all() for n in small[0])
            continue
        for n in small[0]:
            if kw["solver"] != "L2R_L1LOSS_SVC_DUAL":
                assert np.abs(small[0][n] - large[0][n]).max() < 0.01
            if n == 7 and "imbalance" not in kw:
                y = (side > 0.7).astype(float)
                assert objective(large[0][n], slice(None), y, 0.5) <= objective(small[0][n], slice(None), y, 0.5) + 0.05


def test_a_fold_equals_its_loop(spark):
    """AdaGrad over a stream of sorted rows is the plain loop; label blocks take rows together; propensities weigh positives."""
    from thicket.operators.train import train_one_vs_rest

    x, y = blobs(spark, 70, 3)
    d = spark.createDataFrame([(i, y[i], [(j, float(v)) for j, v in enumerate(r)]) for i, r in enumerate(x)], "row_id long, labels array<int>, features array<struct<idx:int,val:double>>").repartition(5)
    c = linear.Csr(np.tile(np.arange(10), 70), x.ravel(), np.full(70, 10))
    for loss, q in (("logistic", 1.0), ("unLogistic", 3.0), ("pwLogistic", 3.0)):
        o = TrainOptions(optimizer="adagrad", loss=loss, epochs=2, weights_threshold=0.0)
        inv = spark.createDataFrame([(0, 3.0), (1, 3.0), (2, 3.0)], "label int, inv_ps double")
        _, w = train_one_vs_rest(d, o, block=2, inv_ps=inv)
        got = {(r["node_id"], r["idx"]): r["w"] for r in w.collect()}
        for lab in range(3):
            _, want, *_ = linear.train_binary(c, [float(lab in v) for v in y], optimizer="adagrad", loss=loss, epochs=2, weights_threshold=0, q=q)
            assert [got[lab, j] for j in range(10)] == pytest.approx(list(want))
    a = d.select(F.lit(0).alias("node_id"), "row_id", F.array_contains("labels", 0).cast("int").alias("y"))
    _, w = train_problems(a, d.select("row_id", "features"), TrainOptions(optimizer="sgd", epochs=3, tmax=100, l2=0.1, weights_threshold=0.0))
    _, want, *_ = linear.train_binary(c, [float(0 in v) for v in y], optimizer="sgd", epochs=3, tmax=100, l2=0.1, weights_threshold=0)
    assert [r["w"] for r in w.orderBy("idx").collect()] == pytest.approx(list(want))


def test_online_and_embedding_models_persist(spark, tmp_path):
    x, y = blobs(spark, 200, 5)
    norm = lambda df: {(r["row_id"], r["label"]): round(r["score"], 9) for r in df.collect()}
    m = OPLT(spark, max_leaves=2, epochs=2).fit(x, y)
    assert p_at_1(spark, y, m.predict(x, top_k=2)) > 0.8 and m.evaluated(x).count() == 200
    m.save(str(tmp_path / "o"))
    again = Model.load(spark, str(tmp_path / "o"))
    assert norm(again.predict_proba(x)) == norm(m.predict_proba(x))
    again.fit(x, [[9]] * 200, resume=True)
    assert again.predict_proba(x, top_k=0).filter("label = 9").count() == 200 and again.tree.filter("label >= 0").count() == 6
    split = np.concatenate([np.maximum(x, 0), np.maximum(-x, 0)], 1)
    e = XT(spark, dims=8, epochs=10, eta=0.5).fit(split, y)
    assert p_at_1(spark, y, e.predict(split, top_k=2)) > 0.7
    e.save(str(tmp_path / "e"))
    assert norm(Model.load(spark, str(tmp_path / "e")).predict_proba(split)) == norm(e.predict_proba(split))


def test_losses_with_propensities_need_them(spark):
    x = spark.createDataFrame([(i, [i % 3], [(i % 3, 1.0)]) for i in range(9)], "row_id long, labels array<int>, features array<struct<idx int, val double>>")
    for loss in ("unLogistic", "pwLogistic"):
        with pytest.raises(ValueError, match="sgd or adagrad"):
            BR(spark, loss=loss)
        with pytest.raises(ValueError, match="inverse propensities"):
            BR(spark, optimizer="sgd", loss=loss).fit(x, x)
        with pytest.raises(ValueError, match="inverse propensities"):
            PLT(spark, optimizer="sgd", loss=loss, tree_type="completeKaryInOrder").fit(x, x)


def test_thresholds_and_biases_of_a_model(spark):
    x, y = blobs(spark, 60, 4)
    m = BR(spark).fit(x, y)
    full = {(r["row_id"], r["label"]): r["score"] for r in m.predict_proba(x, top_k=0).collect()}
    t = spark.createDataFrame([(i, 0.1 * i) for i in range(4)], "label int, threshold double")
    m.set_thresholds(t)
    assert {(r["row_id"], r["label"]) for r in m.predict_proba(x, top_k=0).collect()} == {k for k, v in full.items() if v > 0.1 * k[1]}
    m.set_thresholds(None)
    b = spark.createDataFrame([(3, 5.0)], "label int, bias double")
    assert {r["label"] for r in m.predict_proba(x, top_k=1, labels_biases=b).collect()} == {3}


def test_folds_of_label_blocks_read_the_rows_without_copies(spark, monkeypatch):
    from thicket.operators import linear, train
    from thicket.operators.linear import Csr

    rng = np.random.default_rng(5)
    n, k = 90, 30
    feats = [sorted({-1, *rng.integers(0, 12, 3).tolist(), 100 + i, 300 + i // 2}) for i in range(n)]  # some end early
    labels = [sorted(set(rng.integers(0, k, 2).tolist())) for _ in range(n)]
    vals = [np.round(rng.normal(size=len(f)), 3).tolist() for f in feats]
    d = spark.createDataFrame([(i, labels[i], list(zip(feats[i], vals[i]))) for i in rng.permutation(n).tolist()], "row_id long, labels array<int>, features array<struct<idx:int,val:double>>")
    plans, write = {}, train.write_stage
    monkeypatch.setattr(train, "write_stage", lambda df, name="stage": (plans.__setitem__(name, df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    monkeypatch.setattr(train, "FOLD_WEIGHTS", 300)
    x = Csr(np.concatenate(feats), np.concatenate(vals), np.array([len(f) for f in feats]))
    for o in (TrainOptions(optimizer="adagrad", weights_threshold=0.05), TrainOptions(optimizer="sgd", epochs=2, tmax=130, l2=0.1, weights_threshold=0.05, loss="squaredHinge")):
        models, weights = train.train_one_vs_rest(d, o)
        assert "Exchange" not in plans["trained"]  # rows aren't copied to the blocks
        got, seen = {}, {r["node_id"]: r["class_count"] for r in models.collect()}
        for r in weights.collect():
            assert got.setdefault(r["node_id"], {}).setdefault(r["idx"], r["w"]) == r["w"]
        for label in {v for r in labels for v in r}:
            y = np.array([float(label in r) for r in labels])
            w = linear.online(x, y, o.optimizer, o.loss, o.eta, o.epochs, o.tmax, o.l2, o.adagrad_eps)[0]
            want = {int(i): v for i, v in zip(x.cols, w) if abs(v) > o.weights_threshold or i == -1}
            assert seen[label] == 2 and got[label].keys() == want.keys()
            assert all(abs(got[label][i] - want[i]) < 1e-9 for i in want)


@pytest.mark.parametrize("solver,loss", [("L2R_L2LOSS_SVC", "logistic"), ("L2R_LR", "logistic")])
def test_siblings_share_their_rows(spark, solver, loss, monkeypatch):
    from thicket.operators import assign, train, trees

    rng = np.random.default_rng(8)
    n, k = 120, 14
    labels = [sorted(set(rng.integers(0, k + 2, rng.integers(0, 4)).tolist())) for _ in range(n)]  # some without, some not in the tree
    feats = [[(-1, 1.0), *((int(j), float(v)) for j, v in zip(rng.choice(15, 4, replace=False), rng.normal(size=4)))] for _ in range(n)]
    d = write_stage(spark.createDataFrame(list(zip(range(n), labels, feats)), "row_id long, labels array<int>, features array<struct<idx:int,val:double>>"))
    t, rows = write_stage(trees.complete_tree(spark, k, 4)), d.select("row_id", "features")
    o = TrainOptions(solver=solver, loss=loss, weights_threshold=0.0, eps=1e-3, imbalance=True)
    want = train_problems(assign.nodes_to_update(d, t), rows, o)
    monkeypatch.setattr(train, "SLICE_ROWS", 30)
    moved, write = {}, train.write_stage
    monkeypatch.setattr(train, "write_stage", lambda df, name="stage": moved.setdefault(name, write(df, name)))
    got = train.train_siblings(assign.sibling_groups(d, t), t, rows, o)
    assert moved["groups"].count() * 2 < assign.nodes_to_update(d, t).count()
    key = lambda m: {r["node_id"]: (r["class_count"], r["first_class"], r["n"], round(r["loss"], 4)) for r in m.collect()}
    assert key(got[0]) == key(want[0])
    a, b = ({(r["node_id"], r["idx"]): r["w"] for r in w.collect()} for w in (got[1], want[1]))
    assert all(abs(a.get(x, 0.0) - b.get(x, 0.0)) < 1e-3 for x in a.keys() | b.keys())
