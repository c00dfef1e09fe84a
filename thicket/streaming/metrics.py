"""Metrics over a stream of predictions.

Each micro-batch is joined to the true labels and reduced to sums and counts before
the state is touched, so the state holds one row for each group and cut.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import _at, _cumulate, _gain, _ideal


#: Terms of a row at a cut; a metric is the mean of its term.
_TERMS = {
    "precision": lambda: _cumulate(lambda i: F.lit(1.0)) / F.col("k"),
    "recall": lambda: F.coalesce(F.try_divide(_cumulate(lambda i: F.lit(1.0)), F.size("t")), F.lit(0.0)),
    "dcg": lambda: _cumulate(_gain),
    "ndcg": lambda: F.when(F.size("t") == 0, 0.0).otherwise(_cumulate(_gain) / _ideal()),
    "abandonment": lambda: F.array_contains(F.slice("h", F.lit(1), F.col("k")), True).cast("double"),
}


def metric_stream(pred: DataFrame, truth: DataFrame, k: int = 5, metrics: tuple = ("precision",), by: list[str] | None = None) -> DataFrame:
    """Streaming ``row_id, *by, labels`` against static ``row_id, labels`` -> running ``*by, k, <metric>...``."""
    by = by or []
    t = truth.select("row_id", F.array_distinct(F.array_compact("labels")).alias("t"))
    r = pred.select("row_id", *by, F.array_compact("labels").alias("p")).join(t, "row_id")
    v = _at(r, k).select(*by, "k", *[_TERMS[m]().alias(m) for m in metrics])
    return v.groupBy(*by, "k").agg(*[F.round(F.sum(m) / F.count(F.lit(1)), 6).alias(m) for m in metrics])


def precision_stream(pred: DataFrame, truth: DataFrame, k: int = 5, by: list[str] | None = None) -> DataFrame:
    return metric_stream(pred, truth, k, ("precision",), by)


def set_metric_stream(pred: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Running ``*by, hamming_loss, micro_f1, samples_f1`` of whole label sets."""
    by = by or []
    t = truth.select("row_id", F.array_distinct(F.array_compact("labels")).alias("t"))
    r = pred.select("row_id", *by, F.array_compact("labels").alias("p")).join(t, "row_id")
    v = r.select(*by, F.size("p").alias("np"), F.size("t").alias("nt"), F.size(F.array_intersect("t", "p")).alias("tp"))
    one = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("np") + F.col("nt")), F.lit(0.0))
    s = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("tp").alias("tp"), F.sum(F.col("np") + F.col("nt")).alias("all"), F.sum(one).alias("one"))
    return s.select(
        *by, F.round((F.col("all") - 2 * F.col("tp")) / F.col("n"), 6).alias("hamming_loss"), F.round(F.try_divide(2 * F.col("tp"), "all"), 6).alias("micro_f1"),
        F.round(F.col("one") / F.col("n"), 6).alias("samples_f1"))


def read_result(stream: DataFrame, trigger: dict | None = None) -> DataFrame:
    """Run a complete-mode aggregate over what is there and return its final rows."""
    from ..plans.stages import delete_path, stage_path

    spark, name = stream.sparkSession, f"thicket_{uuid.uuid4().hex}"
    path = stage_path(spark, "checkpoint")
    q = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", path).trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination()
    delete_path(spark, path)
    return spark.table(name)
