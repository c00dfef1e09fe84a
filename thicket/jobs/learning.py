"""Queries that train: their results depend on iterative solvers, so no SQL states them.

Each reports quality or structure over the whole relation; rows whose hashed id falls
in a fixed fifth are held out for evaluation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as fx
from ..models import BR, HSM, MACH, OVR, PLT, XT
from ..operators import labels, metrics, predict
from ..plans.stages import write_stage
from ..streaming import ofo
from ..streaming.online_plt import OnlineOptions, fit_stream, last_state, state_tables
from .reference import points, ranking, vectors


def _split(spark, d) -> tuple[DataFrame, DataFrame]:
    v = write_stage(vectors(spark, d), "vectors")
    held = F.pmod(F.xxhash64("row_id"), F.lit(5)) == 0
    return v.filter(~held), v.filter(held)


def _quality(test: DataFrame, pred: DataFrame) -> DataFrame:
    out = metrics.precision_at_k(test.select("row_id", "labels"), pred, 3)
    return out.select("k", F.round("precision", 6).alias("precision"))


def _fit(make):
    def q(spark, d):
        train, test = _split(spark, d)
        return _quality(test, make(spark).fit(train, train).predict(test, top_k=3))

    return q


def _named(name, f):
    f.__name__ = name
    return f


def online_plt(spark, d):
    """A growing tree fed by a file stream of the training rows."""
    from ..plans.stages import stage_path

    train, test = _split(spark, d)
    rows = train.select("row_id", "labels", fx.prepare(F.col("features")).alias("features"))
    path = stage_path(spark, "stream")
    rows.repartitionByRange(4, "row_id").write.parquet(path)
    state = stage_path(spark, "state")
    fit_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path), state, OnlineOptions(max_leaves=4)).awaitTermination()
    pred = predict.tree_search(test.select("row_id", fx.prepare(F.col("features")).alias("features")), *state_tables(last_state(spark, state)[1]), 3)
    return _quality(test, metrics.from_scores(pred))


def extreme_text(spark, d):
    train, test = _split(spark, d)
    # signed dimensions become two non-negative ones
    split = F.transform("features", lambda f: F.struct((f["idx"] * 2 + (f["val"] > 0).cast("int")).cast("int").alias("idx"), F.abs(f["val"]).alias("val")))
    m = XT(spark, tree_type="completeKaryInOrder", dims=8, epochs=3, eta=0.5, shards=4)
    return _quality(test, m.fit(train.withColumn("features", split), train).predict(test.withColumn("features", split), top_k=3))


def _points(spark, d):
    p = write_stage(points(spark, d), "points")
    held = F.pmod(F.xxhash64("row_id"), F.lit(5)) == 0
    return p.filter(~held), p.filter(held)


def plt_points_train(spark, d):
    """A tree over all labels of the sparse multi-label records."""
    train, test = _points(spark, d)
    return _quality(test, PLT(spark, arity=16, solver="L2R_L2LOSS_SVC").fit(train, train).predict(test, top_k=3))


def br_points_train(spark, d):
    """One problem for each of them, blocks of labels taking the rows together."""
    train, test = _points(spark, d)
    return _quality(test, BR(spark, optimizer="adagrad").fit(train, train).predict(test, top_k=3))


def _probs(spark, d):
    train, test = _split(spark, d)
    m = PLT(spark, tree_type="completeKaryInOrder").fit(train, train)
    p = m.predict_proba(test, top_k=0).groupBy("row_id").agg(F.collect_list(F.struct("label", "score")).alias("probs"))
    return write_stage(test.select("row_id", "labels").join(p, "row_id", "left"), "probs")


def ofo_macro(spark, d):
    return ofo.macro_ofo(_probs(spark, d))


def ofo_mixed(spark, d):
    return ofo.mixed_ofo(_probs(spark, d), labels.labels_priors(vectors(spark, d)), top=5)


def stream_precision(spark, d):
    """Chunked test: predictions arrive as a stream, metric sums are kept by the engine."""
    from ..plans.stages import stage_path
    from ..streaming.metrics import precision_stream, read_result
    path = stage_path(spark, "stream")
    ranking(spark, d).repartition(4).write.parquet(path)
    truth = write_stage(points(spark, d).select("row_id", "labels"), "truth")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    return read_result(precision_stream(stream, truth, 5, ["run_id"]))


def stream_metrics(spark, d):
    """Several metrics of one stream."""
    from ..plans.stages import stage_path
    from ..streaming.metrics import metric_stream, read_result

    path = stage_path(spark, "stream")
    ranking(spark, d).repartition(3).write.parquet(path)
    truth = write_stage(points(spark, d).select("row_id", "labels"), "truth")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    return read_result(metric_stream(stream, truth, 5, ("dcg", "ndcg", "abandonment"), ["run_id"]))


_TRAINED = {
    "plt_kmeans_train": lambda s: PLT(s, max_leaves=4),
    "plt_huffman_adagrad_train": lambda s: PLT(s, tree_type="huffman", optimizer="adagrad", epochs=2),
    "plt_ensemble_train": lambda s: PLT(s, ensemble=2, tree_type="completeKaryRandom"),
    "hsm_train": lambda s: HSM(s, tree_type="completeKaryInOrder", arity=3),
    "br_train": lambda s: BR(s, solver="L2R_LR"),
    "br_squared_hinge_train": lambda s: BR(s, loss="squaredHinge"),
    "br_l1_train": lambda s: BR(s, solver="L1R_LR"),
    "ovr_train": lambda s: OVR(s),
    "mach_train": lambda s: MACH(s, hashes=4, buckets=6),
}
_ALL = [*[_named(n, _fit(m)) for n, m in _TRAINED.items()], online_plt, extreme_text, plt_points_train, br_points_train, ofo_macro, ofo_mixed, stream_precision, stream_metrics]


def queries():
    return {f.__name__: f for f in _ALL}


def oracle_sql():
    from .reference import oracle_sql as sql

    q = sql()
    join = " join ".join(f"({q[m]}) {a}" + (" using (run_id, k)" if a != "x" else "") for m, a in (("dcg_at_k", "x"), ("ndcg_at_k", "y"), ("abandonment_at_k", "z")))
    return {"stream_precision": q["precision_at_k"], "stream_metrics": f"select run_id, k, dcg, ndcg, abandonment from {join}"}
