"""Queries of the multi-label learning operators, and their SQL.

Three relations feed them: ``points`` (data_points, one row a record, multi-label and
sparse), ``vectors`` (embeddings, one label, dense) with unit centroids as given
weights, and the newest scores of ``predictions`` ranked per run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as fx
from ..functions import losses
from ..operators import assign, labels, predict, trees
from ..operators import metrics as mx
from ..plans.stages import write_stage
from ..sources import files

K = 10  # labels of the dense relation are 0..9


def _r(c, name):
    return F.round(c, 6).alias(name)


def points(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/data_points.parquet").filter("row_id is not null")
    newest = p.groupBy("row_id").agg(F.max(F.struct("loaded_at", "labels", "features")).alias("r"))
    return newest.select("row_id", F.coalesce("r.labels", F.array().cast("array<int>")).alias("labels"), fx.combine(F.col("r.features")).alias("features"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    """``row_id, labels`` of the points, written once for the metrics that read them several times."""
    p = spark.read.parquet(f"{d}/data_points.parquet").filter("row_id is not null")
    newest = p.groupBy("row_id").agg(F.max(F.struct("loaded_at", "labels")).alias("r"))
    return write_stage(newest.select("row_id", F.coalesce("r.labels", F.array().cast("array<int>")).alias("labels")), "truth")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("row_id"), F.array("label").alias("labels"), fx.dense_to_sparse(F.col("embedding")).alias("features"))


def newest_scores(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/predictions.parquet").filter("label is not null")
    newest = p.groupBy("run_id", "row_id", "label").agg(F.max(F.struct("scored_at", "score")).alias("r"))
    return newest.select("run_id", "row_id", "label", "r.score")


def ranking(spark: SparkSession, d: str) -> DataFrame:
    """The first five of each row, for the metrics at k."""
    return write_stage(mx.from_scores(newest_scores(spark, d), ["run_id"], 5), "ranking")


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """All that was scored, for the metrics of whole sets."""
    return write_stage(newest_scores(spark, d), "predicted")


def _weights(spark, d) -> DataFrame:
    return labels.label_feature_matrix(vectors(spark, d)).select(F.col("label").alias("node_id"), "idx", F.col("val").alias("w"))


def _tree_model(spark, d, arity=2):
    """A complete tree whose nodes weigh the sum of the centroids below them."""
    t = trees.complete_tree(spark, K, arity)
    leaf = t.filter("label <> -1").select("node_id", "label")
    c = labels.label_feature_matrix(vectors(spark, d))
    w = leaf.join(trees.ancestor_closure(t), "node_id").join(c, "label").groupBy(F.col("ancestor_id").alias("node_id"), "idx").agg(F.sum("val").alias("w"))
    return t, predict.given_models(t), write_stage(w, "weights")


def _rows(spark, d):
    return vectors(spark, d).select("row_id", "features")


# labels ------------------------------------------------------------------------------------
def label_counts(spark, d):
    return labels.count_labels(points(spark, d))


def label_priors(spark, d):
    return labels.labels_priors(points(spark, d), dense=False).select("label", _r(F.col("prior"), "prior"))


def inv_label_priors(spark, d):
    return labels.inverse_labels_priors(points(spark, d), dense=False).select("label", _r(F.col("inv_prior"), "inv_prior"))


def jain_inv_propensity(spark, d):
    return labels.jain_inverse_propensity(points(spark, d), dense=False).select("label", _r(F.col("inv_ps"), "inv_ps"))


def jain_propensity(spark, d):
    return labels.jain_propensity(points(spark, d), dense=False).select("label", _r(F.col("ps"), "ps"))


def label_feature_matrix(spark, d):
    return labels.label_feature_matrix(points(spark, d)).select("label", "idx", _r(F.col("val"), "val"))


def label_feature_mean(spark, d):
    return labels.label_feature_matrix(points(spark, d), norm=False, weighted=True).select("label", "idx", F.round(F.col("val") + 1e-9, 6).alias("val"))  # short decimals meet exact halves


def dataset_stats(spark, d):
    s = files.dataset_stats(points(spark, d))
    return s.select("rows", "nnz", "features", "labels", "label_cells", _r(F.col("avg_labels"), "avg_labels"), _r(F.col("avg_features"), "avg_features"))


def remap_labels(spark, d):
    return files.first_seen_ids(points(spark, d).select(F.lit(0).alias("file_no"), "row_id", "labels"))


def split_train_valid(spark, d):
    return files.split_train_valid(points(spark, d).select("row_id"), 20).select("row_id", "part")


# features -----------------------------------------------------------------------------------
def _long(df):
    return df.select("row_id", F.explode("features").alias("f")).select("row_id", F.col("f.idx").alias("idx"), _r(F.col("f.val"), "val"))


def feature_norm(spark, d):
    return _long(points(spark, d).withColumn("features", fx.unit_norm(F.col("features"))))


def feature_hash_fnv(spark, d):
    return _long(points(spark, d).withColumn("features", fx.hash_features(F.col("features"), 1000)))


def feature_threshold(spark, d):
    return _long(points(spark, d).withColumn("features", fx.threshold_abs(F.col("features"), 0.1)))


def feature_bias(spark, d):
    return _long(points(spark, d).withColumn("features", fx.add_bias(F.col("features"))))


def feature_dense(spark, d):
    dense = fx.sparse_to_dense(fx.dense_to_sparse(F.col("embedding")), 64)
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode(dense).alias("idx", "val"))
    return e.select("vec_id", "idx", _r(F.col("val"), "val"))


def pairwise_dot(spark, d):
    v = vectors(spark, d)
    a = v.select((F.col("row_id") + 1).alias("row_id"), F.col("features").alias("g"))
    return v.join(a, "row_id").select("row_id", _r(fx.dot(F.col("features"), F.col("g")), "dot"), F.size(fx.add(F.col("features"), F.col("g"))).alias("n_sum"))


def libsvm_lines(spark, d):
    return points(spark, d).select("row_id", files.libsvm_line(F.col("labels"), F.transform("features", lambda f: F.struct(f["idx"].alias("idx"), F.round(f["val"] * 1000).cast("int").alias("val"))), True).alias("line"))


def loss_values(spark, d):
    p = spark.read.parquet(f"{d}/predictions.parquet").filter("score is not null and not isnan(score) and label is not null")
    y, v, q = (F.col("label") % 2).cast("double"), F.col("score") * 4 - 2, F.lit(3.0)
    one = p.select("run_id", losses.logistic_loss(y, v).alias("a"), losses.squared_hinge_loss(y, v).alias("b"), losses.un_logistic_loss(y, v, q).alias("c"), losses.pw_logistic_loss(y, v, q).alias("e"), losses.pw_logistic_grad(y, v, q).alias("g"), losses.squared_hinge_grad(y, v).alias("h"))
    return one.groupBy("run_id").agg(*[_r(F.avg(x), n) for x, n in (("a", "logistic"), ("b", "squared_hinge"), ("c", "un_logistic"), ("e", "pw_logistic"), ("g", "pw_grad"), ("h", "hinge_grad"))])


# metrics ------------------------------------------------------------------------------------
def _metric(f, name, inv=False, source=ranking, **kw):
    def q(spark, d):
        true, pred = truth(spark, d), source(spark, d)
        args = (true, pred, labels.jain_inverse_propensity(true, dense=False)) if inv else (true, pred)
        out = f(*args, by=["run_id"], **kw)
        return out.select(*[_r(F.col(c), c) if c not in ("run_id", "k") else F.col(c) for c in out.columns])

    q.__name__ = name
    return q


def cli_metrics(spark, d):
    m = mx.cli_metrics(truth(spark, d), predicted(spark, d), 3, by=["run_id"])
    return m.select("run_id", "metric", _r(F.col("value"), "value"), _r(F.col("std"), "std"))


def cli_set_metrics(spark, d):
    """The command line's metrics of whole label sets and the coverage of the first five."""
    true, pred = truth(spark, d), predicted(spark, d)
    parts = [
        mx.micro_f1(true, pred, ["run_id"]).select("run_id", F.lit("microf1").alias("metric"), F.col("micro_f1").alias("value")),
        mx.macro_f1(true, pred, 1.0, ["run_id"]).select("run_id", F.lit("macrof1").alias("metric"), F.col("macro_f1").alias("value")),
        mx.coverage_at_k(true, ranking(spark, d), 5, ["run_id"]).filter("k = 5").select("run_id", F.lit("c@5").alias("metric"), F.col("coverage").alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("run_id", "metric", _r(F.col("value"), "value"))


# trees --------------------------------------------------------------------------------------
def tree_complete(spark, d):
    return trees.complete_tree(spark, 5, 3).withColumn("arity", F.lit(3)).unionByName(trees.complete_tree(spark, 5000, 7).withColumn("arity", F.lit(7)))


def tree_balanced(spark, d):
    t = trees.node_depths(trees.balanced_tree(spark, 1000, 3, 10))
    return t.filter("label <> -1").select("label", "depth")


def tree_stats(spark, d):
    return trees.tree_stats(trees.complete_tree(spark, 1000, 4))


def ancestor_closure(spark, d):
    return trees.ancestor_closure(trees.complete_tree(spark, 500, 3))


# assignment ---------------------------------------------------------------------------------
def nodes_to_update(spark, d):
    return assign.nodes_to_update(vectors(spark, d), trees.complete_tree(spark, K, 2))


def nodes_updates(spark, d):
    return assign.nodes_updates(vectors(spark, d), trees.complete_tree(spark, K, 2)).groupBy("node_id").agg(F.count("row_id").alias("rows"), F.sum("y").cast("long").alias("positives"))


def hsm_assignment(spark, d):
    return assign.hsm_assignment(vectors(spark, d), trees.complete_tree(spark, K, 3)).groupBy("node_id", "y").agg(F.count(F.lit(1)).alias("rows"), _r(F.sum("weight"), "weight"))


def br_assignment(spark, d):
    """Positives of the labels that at least three rows have."""
    p = write_stage(points(spark, d).select("row_id", "labels"), "points")
    return assign.br_assignment(p, labels.count_labels(p, dense=False).filter("cnt >= 3"))


def ovr_pick_one_weights(spark, d):
    return assign.ovr_assignment(points(spark, d)).select("row_id", "label", _r(F.col("weight"), "weight"))


_FAMILY = assign.mach_hashes(200000, 3, 50)


def mach_assignment(spark, d):
    return assign.mach_assignment(points(spark, d), _FAMILY, 50)


# inference with given weights -----------------------------------------------------------------
def _scores(df):
    return df.select("row_id", "label", _r(F.col("score"), "score"))


def nearest_centroid_precision(spark, d):
    """Centroids, scores, softmax, top 5 and precision in one plan."""
    w = _weights(spark, d)
    m = predict.given_models(w.select("node_id").distinct())
    top = predict.ovr_predict(_rows(spark, d), m, w, 5)
    out = mx.precision_at_k(vectors(spark, d).select("row_id", "labels"), mx.from_scores(top), 5)
    return out.select("k", _r(F.col("precision"), "precision"))


def ovr_softmax_topk(spark, d):
    w = _weights(spark, d)
    return _scores(predict.ovr_predict(_rows(spark, d), predict.given_models(w.select("node_id").distinct()), w, 3))


def br_topk(spark, d):
    w = _weights(spark, d)
    return _scores(predict.br_predict(_rows(spark, d), predict.given_models(w.select("node_id").distinct()), w, 3))


def br_threshold(spark, d):
    w = _weights(spark, d)
    return _scores(predict.br_predict(_rows(spark, d), predict.given_models(w.select("node_id").distinct()), w, 0, threshold=0.6))


def plt_exact_topk(spark, d):
    return _scores(predict.plt_predict(_rows(spark, d), *_tree_model(spark, d), k=3))


def plt_full_scoring(spark, d):
    t, m, w = _tree_model(spark, d)
    return _scores(predict.top_k(predict.plt_scores(_rows(spark, d), t, m, w), 3))


def plt_threshold(spark, d):
    return _scores(predict.plt_predict(_rows(spark, d), *_tree_model(spark, d), k=0, threshold=0.05))


def plt_label_thresholds(spark, d):
    thr = spark.range(K).select(F.col("id").cast("int").alias("label"), (0.02 + F.col("id") * 0.01).alias("threshold"))
    return _scores(predict.plt_predict(_rows(spark, d), *_tree_model(spark, d), k=0, label_thresholds=thr))


def plt_weighted_topk(spark, d):
    lw = spark.range(K).select(F.col("id").cast("int").alias("label"), (1.0 + F.col("id") * 0.1).alias("weight"))
    return _scores(predict.plt_predict(_rows(spark, d), *_tree_model(spark, d), k=3, label_weights=lw))


def node_bounds(spark, d):
    thr = spark.range(K).select(F.col("id").cast("int").alias("label"), ((F.col("id") * 7) % 5 + 0.5).alias("threshold"))
    return predict.node_bounds(trees.complete_tree(spark, K, 2), thr, "threshold", "min")


def predict_for_label(spark, d):
    rows = _rows(spark, d)
    pairs = rows.select("row_id", (F.col("row_id") % 12).cast("int").alias("label"))
    return _scores(predict.predict_for_label(rows, pairs, *_tree_model(spark, d)))


def hsm_topk(spark, d):
    return _scores(predict.hsm_predict(_rows(spark, d), *_tree_model(spark, d, 3), k=3))


def mach_topk(spark, d):
    """Buckets weigh the centroids of their labels."""
    fam = assign.mach_hashes(K, 3, 4)
    b = assign.mach_buckets(spark.range(K).select(F.col("id").cast("int").alias("label")), fam, 4)
    c = labels.label_feature_matrix(vectors(spark, d))
    w = b.join(c, "label").groupBy((F.col("hash_no") * 4 + F.col("bucket")).alias("node_id"), "idx").agg(F.sum("val").alias("w"))
    v = predict.all_values(_rows(spark, d), predict.given_models(w.select("node_id").distinct()), w)
    p = v.select("row_id", F.expr("node_id div 4").cast("int").alias("hash_no"), (F.col("node_id") % 4).alias("bucket"), losses.sigmoid(F.col("value")).alias("p"))
    return _scores(predict.mach_predict(p, b, 3))


def ensemble_mean(spark, d):
    """Two members with different arity, the second cut to its top 3."""
    rows = _rows(spark, d)
    a = predict.plt_scores(rows, *_tree_model(spark, d, 2)).withColumn("member", F.lit(0))
    b = predict.top_k(predict.plt_scores(rows, *_tree_model(spark, d, 3)), 3).withColumn("member", F.lit(1))
    return _scores(predict.ensemble_mean(a.unionByName(b), 2, 3))


def ensemble_filled(spark, d):
    rows = _rows(spark, d)
    a = predict.plt_scores(rows, *_tree_model(spark, d, 2)).withColumn("member", F.lit(0))
    full = predict.plt_scores(rows, *_tree_model(spark, d, 3)).withColumn("member", F.lit(1))
    return _scores(predict.ensemble_filled(a.unionByName(predict.top_k(full, 3)), a.unionByName(full), 2, 3))


_METRICS = [
    _metric(mx.precision_at_k, "precision_at_k"), _metric(mx.recall_at_k, "recall_at_k", zero_division=1), _metric(mx.dcg_at_k, "dcg_at_k"), _metric(mx.ndcg_at_k, "ndcg_at_k"),
    _metric(mx.psprecision_at_k, "psp_at_k", True), _metric(mx.psrecall_at_k, "psr_at_k", True), _metric(mx.psdcg_at_k, "psdcg_at_k", True), _metric(mx.psndcg_at_k, "psndcg_at_k", True),
    _metric(mx.abandonment_at_k, "abandonment_at_k"), _metric(mx.coverage_at_k, "coverage_at_k"), _metric(mx.hamming_loss, "hamming_loss", source=predicted), _metric(mx.micro_f1, "micro_f1", source=predicted),
    _metric(mx.macro_f1, "macro_f1", source=predicted), _metric(mx.samples_f1, "samples_f1", source=predicted), _metric(mx.macro_at_k, "macro_pr_at_k"),
]
_ALL = [
    label_counts, label_priors, inv_label_priors, jain_inv_propensity, jain_propensity, label_feature_matrix, label_feature_mean, dataset_stats, remap_labels, split_train_valid,
    feature_norm, feature_hash_fnv, feature_threshold, feature_bias, feature_dense, pairwise_dot, libsvm_lines, loss_values, *_METRICS, cli_metrics, cli_set_metrics,
    tree_complete, tree_balanced, tree_stats, ancestor_closure,
    nodes_to_update, nodes_updates, hsm_assignment, br_assignment, ovr_pick_one_weights, mach_assignment,
    nearest_centroid_precision, ovr_softmax_topk, br_topk, br_threshold, plt_exact_topk, plt_full_scoring, plt_threshold, plt_label_thresholds, plt_weighted_topk, node_bounds,
    predict_for_label, hsm_topk, mach_topk, ensemble_mean, ensemble_filled,
]


def queries():
    return {f.__name__: f for f in _ALL}


# SQL ------------------------------------------------------------------------------------------
_P = """r as (select row_id, arg_max(struct_pack(l := labels, f := features), loaded_at) x from data_points where row_id is not null group by 1),
y as (select distinct row_id, label from (select row_id, unnest(x.l) as label from r) where label is not null),
n as (select count(*) n from r), c as (select label, count(*) cnt from y group by 1),
f as (select row_id, idx, val from (select row_id, u.idx idx, sum(u.val) val from (select row_id, unnest(x.f) u from r) where u.idx is not null and u.val is not null group by 1, 2) where val <> 0)"""
_Q = f"""{_P}, k5 as (select run_id, row_id, label, arg_max(struct_pack(s := score), scored_at).s score from predictions where label is not null group by 1, 2, 3),
p as (select * from (select run_id, row_id, label, row_number() over (partition by run_id, row_id order by score desc, label) pos from k5 where score is not null and not isnan(score)) where pos <= 5),
h as (select p.*, y.label is not null as hit from p left join y on y.row_id = p.row_id and y.label = p.label where p.row_id in (select row_id from r)),
b as (select run_id, row_id, count(*) np, sum(hit::int) tp from h group by 1, 2),
nt as (select r.row_id, count(y.label) t from r left join y using (row_id) group by 1), ks as (select i k from range(1, 6) g(i)),
a as (select b.run_id, b.row_id, k, t, coalesce(sum(hit::int) filter (pos <= k), 0) hits, coalesce(sum(1 / log2(pos + 1)) filter (pos <= k and hit), 0) dcg,
  (select sum(1 / log2(i + 1)) from range(1, 6) g(i) where i <= least(k, greatest(t, 1))) ideal
  from b join nt using (row_id) cross join ks join h on h.run_id = b.run_id and h.row_id = b.row_id group by b.run_id, b.row_id, k, t)"""
_S = _Q.replace(" where pos <= 5", "")
_PS = f"""{_Q}, q as (select label, 1 + (ln(n::double) - 1) * pow(2.5, 0.55) * pow(cnt + 1.5, -0.55) q from c, n),
tq as (select row_id, q, row_number() over (partition by row_id order by q desc) pos from y join q using (label)),
pa as (select a.run_id, a.row_id, k, any_value(t) t, any_value(ideal) ideal, coalesce(sum(q.q) filter (pos <= k and hit), 0) g, coalesce(sum(q.q / log2(pos + 1)) filter (pos <= k and hit), 0) gd
  from a join h using (run_id, row_id) left join q using (label) group by 1, 2, 3),
pb as (select row_id, k, coalesce(sum(q) filter (pos <= k), 0) g0, coalesce(sum(q / log2(pos + 1)) filter (pos <= k), 0) gd0 from r left join tq using (row_id) cross join ks group by 1, 2)"""
_CONF = f"""{_S}, conf as (select run_id, label, sum(tp) tp, sum(fp) fp, sum(fn) fn from (
  select run_id, label, hit::int tp, (not hit)::int fp, 0 fn from h
  union all select b.run_id, y.label, 0, 0, 1 from b join y using (row_id) where not exists (select 1 from h where h.run_id = b.run_id and h.row_id = b.row_id and h.label = y.label)) group by 1, 2)"""
_CONFK = f"""{_Q}, conf as (select run_id, k, label, sum(tp) tp, sum(fp) fp, sum(fn) fn from (
  select run_id, k, label, hit::int tp, (not hit)::int fp, 0 fn from h, ks where pos <= k
  union all select b.run_id, k, y.label, 0, 0, 1 from b join y using (row_id) cross join ks where not exists (select 1 from h where h.run_id = b.run_id and h.row_id = b.row_id and h.label = y.label and pos <= k)) group by 1, 2, 3)"""
_V = """e as (select vec_id row_id, label, unnest(range(len(embedding))) idx, unnest(embedding)::double val from embeddings),
cs as (select label, idx, sum(val) s from e where val <> 0 group by 1, 2), cw as (select label, idx, s / sqrt(sum(s * s) over (partition by label)) w from cs)"""


def _flat(body, tail):
    return f"with {_V}, v as (select row_id, cw.label, sum(val * w) v from e join cw using (idx) group by 1, 2), {body} {tail}"


def _tree_ctes(arity, x=""):
    """Relations of a complete tree, its node weights, node and label scores; names end in ``x``."""
    t = -((1 - arity * K) // (arity - 1))
    first = t - K
    return f"""t{x} as (select i::int node_id, (case when i = 0 then -1 else (i - 1) // {arity} end)::int parent_id, (case when i >= {first} then i - {first} else -1 end)::int as label from range({t}) g(i)),
cl{x}(node_id, ancestor_id, distance) as (select node_id, node_id, 0 from t{x} union all select c.node_id, u.parent_id, distance + 1 from cl{x} c join t{x} u on u.node_id = c.ancestor_id where u.parent_id <> -1),
nw{x} as (select ancestor_id node_id, idx, sum(w) w from t{x} u join cl{x} using (node_id) join cw on cw.label = u.label group by 1, 2),
nv{x} as (select row_id, node_id, sum(val * w) v from e join nw{x} using (idx) group by 1, 2), np{x} as (select row_id, node_id, 1 / (1 + exp(-v)) p from nv{x}),
s{x} as (select row_id, u.label, product(p) score from t{x} u join cl{x} c using (node_id) join np{x} q on q.node_id = c.ancestor_id where u.label <> -1 group by 1, 2)"""


def _tree_sql(arity, rest):
    return f"with recursive {_V}, {_tree_ctes(arity)} {rest}"


def _topk(k, table="s", score="score"):
    return f"select row_id, label::int as label, round({score}, 6) score from (select *, row_number() over (partition by row_id order by {score} desc, label) rn from {table}) where rn <= {k}"


def _fnv(x):
    h = "2166136261"
    for s in (0, 8, 16, 24):
        h = f"((xor({h}::bigint, (({x}) >> {s}) & 255) * 16777619) & 4294967295)"
    return h


def _complete_sql(k, a):
    t = -((1 - a * k) // (a - 1))
    return f"select i::int node_id, (case when i = 0 then -1 else (i - 1) // {a} end)::int parent_id, (case when i >= {t - k} then i - {t - k} else -1 end)::int as label, {a} arity from range({t}) g(i)"


def _hsm_sql(rest):
    ctes = _tree_ctes(3)
    return f"""with recursive {_V}, {ctes[: ctes.index("np as (")]}
cp as (select node_id, parent_id, row_number() over (partition by parent_id order by node_id) - 1 cpos, count(*) over (partition by parent_id) nc from t where parent_id <> -1),
hp as (select nv.row_id, nv.node_id, case when cp.parent_id is null then 1 / (1 + exp(-v))
  when nc = 2 then (case when cpos = 0 then 1 / (1 + exp(-v)) else 1 - max(case when cpos = 0 then 1 / (1 + exp(-v)) end) over (partition by row_id, cp.parent_id) end)
  else exp(v) / sum(exp(v)) over (partition by row_id, cp.parent_id) end p from nv left join cp using (node_id)),
s as (select row_id, t.label, product(p) score from t join cl using (node_id) join hp on hp.node_id = cl.ancestor_id where t.label <> -1 group by 1, 2) {rest}"""


def _mach_sql():
    fam = assign.mach_hashes(K, 3, 4)
    b = " union all ".join(f"select l::int as label, {i} hash_no, ({a} * l % {m} % 4)::int bucket from range({K}) g(l)" for i, (a, m) in enumerate(fam))
    return f"""with {_V}, b as ({b}), w as (select hash_no, bucket, idx, sum(cw.w) w from b join cw on cw.label = b.label group by 1, 2, 3),
p as (select row_id, hash_no, bucket, 1 / (1 + exp(-sum(val * w))) p from e join w using (idx) group by 1, 2, 3),
s as (select row_id, b.label, 1 + sum(p) score from p join b using (hash_no, bucket) group by 1, 2) {_topk(3)}"""


def oracle_sql():
    at = lambda v, name: f"with {_Q} select run_id, k::int k, round(avg({v}), 6) \"{name}\" from a group by 1, 2"
    ps = lambda x, y, name: f"with {_PS} select run_id, k::int k, round(sum({x}) / sum({y}), 6) {name} from pa join pb using (row_id, k) group by 1, 2"
    macro = lambda num, den, name: f"round(sum(case when {den} > 0 then {num}::double / ({den}) else 0 end) / (max(label) + 1), 6) {name}"
    both = f"with recursive {_V}, {_tree_ctes(2)}, {_tree_ctes(3, '3')}"
    out = {
        "label_counts": f"with {_P} select i::int as label, coalesce(cnt, 0) cnt from range((select max(label) + 1 from c)) g(i) left join c on c.label = i",
        "label_priors": f"with {_P} select label, round(cnt / n, 6) prior from c, n",
        "inv_label_priors": f"with {_P} select label, round(n / cnt, 6) inv_prior from c, n",
        "jain_inv_propensity": f"with {_P} select label, round(1 + (ln(n::double) - 1) * pow(2.5, 0.55) * pow(cnt + 1.5, -0.55), 6) inv_ps from c, n",
        "jain_propensity": f"with {_P} select label, round(1 / (1 + (ln(n::double) - 1) * pow(2.5, 0.55) * pow(cnt + 1.5, -0.55)), 6) ps from c, n",
        "label_feature_matrix": f"with {_P}, m as (select label, idx, sum(val) v from y join f using (row_id) group by 1, 2), l as (select *, sqrt(sum(v * v) over (partition by label)) len from m) select label, idx, round(case when len = 0 then v else v / len end, 6) val from l",
        "label_feature_mean": f"with {_P}, z as (select row_id, count(*) + 1 nnz from f group by 1), m as (select label, idx, sum(val / nnz) v from y join f using (row_id) join z using (row_id) group by 1, 2) select label, idx, round(v / cnt + 1e-9, 6) val from m join c using (label)",
        "dataset_stats": f"""with {_P}, ny as (select row_id, coalesce(len(x.l), 0) ny, list_max(x.l) my from r), nf as (select row_id, count(*) nf, max(idx) mf from f group by 1)
            select count(*) as rows, sum(coalesce(nf, 0))::bigint nnz, max(mf) + 1 features, max(my) + 1 labels, sum(ny)::bigint label_cells, round(avg(ny), 6) avg_labels, round(avg(coalesce(nf, 0)), 6) avg_features from ny left join nf using (row_id)""",
        "remap_labels": f"with {_P}, u as (select row_id, unnest(x.l) as label, generate_subscripts(x.l, 1) pos from r), m as (select label, min(struct_pack(row_id, pos)) seen from u where label is not null group by 1) select label, (row_number() over (order by seen) - 1)::int new_label from m",
        "split_train_valid": f"with {_P} select row_id, case when row_number() over (order by md5(row_id || ':42'), row_id) <= floor(n * 20 / 100) then 'valid' else 'train' end part from r, n",
        "feature_norm": f"with {_P} select row_id, idx, round(val / sqrt(sum(val * val) over (partition by row_id)), 6) val from f",
        "feature_hash_fnv": f"with {_P} select row_id, ({_fnv('(idx + 2)::bigint')} % 1000 + 2)::int idx, round(sum(val), 6) val from f group by 1, 2 having sum(val) <> 0",
        "feature_threshold": f"with {_P} select row_id, idx, round(val, 6) val from f where abs(val) > 0.1",
        "feature_bias": f"with {_P} select row_id, idx, round(val, 6) val from f union all select row_id, -1, 1.0 from r",
        "feature_dense": "select vec_id, (unnest(range(len(embedding))))::int idx, round(unnest(embedding)::double, 6) val from embeddings",
        "pairwise_dot": f"with {_V} select a.row_id, round(sum(a.val * b.val), 6) dot, count(*) filter (a.val + b.val <> 0)::int n_sum from e a join e b on b.row_id = a.row_id - 1 and a.idx = b.idx group by 1",
        "libsvm_lines": f"""with {_P}, g as (select row_id, string_agg(idx || ':' || round(val * 1000)::int, ' ' order by idx) t from f group by 1)
            select row_id, coalesce(array_to_string(list_filter(x.l, lambda v: v is not null), ','), '') || coalesce(' ' || t, '') line from r left join g using (row_id)""",
        "loss_values": """with s as (select run_id, (label % 2)::double y, score * 4 - 2 v from predictions where score is not null and not isnan(score) and label is not null),
            t as (select *, greatest(v, 0) + ln(1 + exp(-abs(v))) sp, greatest(-v, 0) + ln(1 + exp(-abs(v))) sn, 1 / (1 + exp(-v)) g, 2 * y - 1 z from s)
            select run_id, round(avg(sp - y * v), 6) logistic, round(avg(pow(greatest(0, 1 - z * v), 2)), 6) squared_hinge, round(avg(sp - 3 * y * v), 6) un_logistic, round(avg(5 * y * sn + (1 - y) * sp), 6) pw_logistic,
            round(avg((1 - y) * g - 5 * y * (1 - g)), 6) pw_grad, round(avg(case when z * v < 1 then -2 * z * (1 - z * v) else 0 end), 6) hinge_grad from t group by 1""",
        "precision_at_k": at("hits / k", "precision"),
        "recall_at_k": at("case when t = 0 then 1 else hits / t end", "recall"),
        "dcg_at_k": at("dcg", "dcg"),
        "ndcg_at_k": at("case when t = 0 then 0 else dcg / ideal end", "ndcg"),
        "abandonment_at_k": at("(hits > 0)::int", "abandonment"),
        "psp_at_k": ps("g / k", "g0 / k", "psprecision"),
        "psr_at_k": ps("case when t = 0 then 0 else g / t end", "case when t = 0 then 0 else g0 / t end", "psrecall"),
        "psdcg_at_k": ps("gd / k", "gd0 / k", "psdcg"),
        "psndcg_at_k": ps("case when t = 0 then 0 else gd / ideal end", "case when t = 0 then 0 else gd0 / ideal end", "psndcg"),
        "coverage_at_k": f"with {_Q}, seen as (select run_id, count(distinct label) s from b join y using (row_id) group by 1) select s.run_id, k::int k, round(count(distinct label) filter (hit and pos <= k) / any_value(s.s), 6) coverage from seen s cross join ks left join h on h.run_id = s.run_id group by 1, 2",
        "hamming_loss": f"with {_S} select run_id, round(avg(np + t - 2 * tp), 6) hamming_loss from b join nt using (row_id) group by 1",
        "micro_f1": f"with {_S} select run_id, round(2 * sum(tp) / sum(np + t), 6) micro_f1 from b join nt using (row_id) group by 1",
        "samples_f1": f"with {_S} select run_id, round(avg(case when tp > 0 then 2 * (tp / np) * (tp / t) / (tp / np + tp / t) else 0 end), 6) samples_f1 from b join nt using (row_id) group by 1",
        "macro_f1": f"with {_CONF} select run_id, {macro('(2 * tp)', '2 * tp + fp + fn', 'macro_f1')} from conf group by 1",
        "macro_pr_at_k": f"with {_CONFK} select run_id, k::int k, {macro('tp', 'tp + fp', 'macro_precision')}, {macro('tp', 'tp + fn', 'macro_recall')}, {macro('(2 * tp)', '2 * tp + fp + fn', 'macro_f1')} from conf group by 1, 2",
        "tree_complete": f"{_complete_sql(5, 3)} union all {_complete_sql(5000, 7)}",
        "tree_balanced": """with recursive g(s, n, d) as (select 0, 1000, 1 union all
            select (s + j * (n // kids) + least(j, n % kids))::int, (n // kids + (j < n % kids)::int)::int, d + 1 from (select *, case when n > 10 then 3 else n end kids from g where n > 1), range(10) x(j) where j < kids)
            select s::int as label, d depth from g where n = 1""",
        "tree_stats": f"""with recursive t as ({_complete_sql(1000, 4)}), w(node_id, d) as (select node_id, 1 from t where parent_id = -1 union all select t.node_id, d + 1 from w join t on t.parent_id = w.node_id)
            select count(*) nodes, count(*) filter (label <> -1) leaves, count(*) filter (label = -1) internal, max(d) depth from t join w using (node_id)""",
        "ancestor_closure": f"""with recursive t as ({_complete_sql(500, 3)}), cl(node_id, ancestor_id, distance) as (select node_id, node_id, 0 from t union all select cl.node_id, t.parent_id, distance + 1 from cl join t on t.node_id = cl.ancestor_id where t.parent_id <> -1) select * from cl""",
        "nodes_to_update": _tree_sql(2, """, po as (select distinct vec_id row_id, ancestor_id node_id from embeddings join t using (label) join cl using (node_id)),
            ng as (select po.row_id, t.node_id from po join t on t.parent_id = po.node_id except select * from po) select row_id, node_id, 1 y from po union all select row_id, node_id, 0 from ng"""),
        "nodes_updates": _tree_sql(2, """, po as (select distinct vec_id row_id, ancestor_id node_id from embeddings join t using (label) join cl using (node_id)),
            ng as (select po.row_id, t.node_id from po join t on t.parent_id = po.node_id except select * from po), u as (select *, 1 y from po union all select *, 0 from ng)
            select t.node_id, count(row_id) as rows, sum(y)::bigint positives from t left join u using (node_id) group by 1"""),
        "hsm_assignment": _tree_sql(3, """, cp as (select node_id, parent_id, row_number() over (partition by parent_id order by node_id) - 1 cpos, count(*) over (partition by parent_id) nc from t where parent_id <> -1),
            pa as (select vec_id row_id, ancestor_id node_id from embeddings join t using (label) join cl using (node_id)),
            u as (select row_id, node_id, 1 y from pa where node_id = 0 union all select pa.row_id, s.node_id, (s.node_id = pa.node_id)::int from pa join cp using (node_id) join cp s on s.parent_id = cp.parent_id where s.nc <> 2 or s.cpos = 0)
            select node_id, y, count(*) as rows, count(*)::double weight from u group by 1, 2"""),
        "br_assignment": f"with {_P} select label::int node_id, row_id from y where label in (select label from c where cnt >= 3)",
        "ovr_pick_one_weights": f"with {_P} select row_id, label, round(1.0 / count(*) over (partition by row_id), 6) weight from y",
        "mach_assignment": f"with {_P} select distinct row_id, hash_no, bucket, 1 y from (" + " union all ".join(f"select row_id, {i} hash_no, ({a}::bigint * label % {m} % 50)::int bucket from y" for i, (a, m) in enumerate(_FAMILY)) + ")",
        "nearest_centroid_precision": _flat("k as (select row_id, label, row_number() over (partition by row_id order by v desc, label) pos from v)", "select i::int k, round(avg(h / i), 6) \"precision\" from (select i, vec_id, count(*) filter (k.label = m.label and pos <= i) h from embeddings m join k on k.row_id = vec_id cross join range(1, 6) g(i) group by 1, 2) group by 1"),
        "ovr_softmax_topk": _flat("s as (select row_id, label, exp(v) / sum(exp(v)) over (partition by row_id) score from v)", _topk(3)),
        "br_topk": _flat("s as (select row_id, label, 1 / (1 + exp(-v)) score from v)", _topk(3)),
        "br_threshold": _flat("s as (select row_id, label, 1 / (1 + exp(-v)) score from v)", "select row_id, label, round(score, 6) score from s where score > 0.6"),
        "plt_exact_topk": _tree_sql(2, _topk(3)),
        "plt_full_scoring": _tree_sql(2, _topk(3)),
        "plt_threshold": _tree_sql(2, "select row_id, label, round(score, 6) score from s where score >= 0.05"),
        "plt_label_thresholds": _tree_sql(2, "select row_id, label, round(score, 6) score from s where score >= 0.02 + label * 0.01"),
        "plt_weighted_topk": _tree_sql(2, ", x as (select row_id, label, score * (1 + label * 0.1) score from s) " + _topk(3, "x")),
        "node_bounds": _tree_sql(2, "select node_id, b.v bound, b.l as label from (select ancestor_id node_id, min(struct_pack(v := (label * 7 % 5 + 0.5)::double, l := label)) b from t join cl using (node_id) where label <> -1 group by 1)"),
        "predict_for_label": _tree_sql(2, "select vec_id row_id, (vec_id % 12)::int as label, round(coalesce(score, 0), 6) score from embeddings m left join s on s.row_id = vec_id and s.label = vec_id % 12"),
        "hsm_topk": _hsm_sql(_topk(3)),
        "mach_topk": _mach_sql(),
        "ensemble_mean": f"{both}, k3 as (select *, row_number() over (partition by row_id order by score desc, label) rn from s3), x as (select s.row_id, s.label, (s.score + coalesce(k3.score, 0)) / 2 score from s left join k3 on k3.row_id = s.row_id and k3.label = s.label and rn <= 3) {_topk(3, 'x')}",
        "ensemble_filled": f"{both}, x as (select row_id, label, (s.score + s3.score) / 2 score from s join s3 using (row_id, label)) {_topk(3, 'x')}",
    }
    macro1 = f"with {_CONF} select run_id, 'macrof1' metric, (sum(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 1 end) + max(label) + 1 - count(*)) / (max(label) + 1) v from conf group by 1"
    micro = f"with {_S} select run_id, 'microf1' metric, 2 * sum(tp) / sum(np + t) v from b join nt using (row_id) group by 1"
    out["cli_set_metrics"] = f"""select run_id, metric, round(v, 6) "value" from (select * from ({micro}) union all select * from ({macro1}) union all select run_id, 'c@5', coverage from ({out['coverage_at_k']}) where k = 5)"""
    cli = {"p@3": "hits / 3", "r@3": "case when t > 0 then hits / t end", "dcg@3": "dcg", "ndcg@3": "case when t > 0 then dcg / ideal else 0 end", "tp@3": "hits", "tp": "tp", "fp": "np - tp", "fn": "t - tp",
           "p": "tp / np", "r": "case when t > 0 then tp / t end", "hl": "np + t - 2 * tp", "samplef1": "case when tp > 0 then 2 * (tp / np) * (tp / t) / (tp / np + tp / t) end", "s": "np"}
    acc = "select run_id, 'acc' metric, coalesce((p1.label = y1.label)::int, 0)::double v from b join (select run_id, row_id, label from p where pos = 1) p1 using (run_id, row_id) left join (select row_id, list_filter(x.l, lambda v: v is not null)[1] as label from r) y1 on y1.row_id = b.row_id"
    out["cli_metrics"] = f"with {_S}, ab as (select a.*, np, tp from a join b using (run_id, row_id) where k = 3) select run_id, metric, round(avg(v), 6) \"value\", round(stddev_pop(v), 6) std from (" + " union all ".join(f"select run_id, '{m}' metric, ({v})::double v from ab" for m, v in cli.items()) + f" union all {acc}) where v is not null group by 1, 2"
    return out
