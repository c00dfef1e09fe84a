"""Label statistics: counts, priors, propensities and label-feature centroids.

Input is ``row_id, labels array<int>`` (and ``features array<struct<idx,val>>`` for
centroids).  A label repeated in one row counts once, null members are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dataset specific (A, B) of the propensity model; every other data set has 0.55, 1.5.
PROPENSITY_PARAMETERS = {
    "wikilshtc": (0.5, 0.4),
    "wikipedialarge": (0.5, 0.4),
    "amazon-670k": (0.6, 2.6),
    "amazon-3m": (0.6, 2.6),
}


def propensity_parameters(dataset: str) -> tuple[float, float]:
    name = dataset.lower()
    return next((v for k, v in PROPENSITY_PARAMETERS.items() if name.startswith(k)), (0.55, 1.5))


def label_rows(data: DataFrame) -> DataFrame:
    """``row_id, label``, one row per label that a row has."""
    return data.select("row_id", F.explode(F.array_distinct(F.array_compact("labels"))).alias("label"))


def count_labels(data: DataFrame, dense: bool = True) -> DataFrame:
    """``label, cnt``; dense: every label from 0 to the largest, unseen ones with 0."""
    c = label_rows(data).groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))
    if not dense:
        return c
    # one row carries the bound, so the range is made on the executors
    top = c.agg(F.max("label").alias("m")).filter("m is not null")
    every = top.select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("label"))
    return every.join(c, "label", "left").select("label", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def with_row_count(counts: DataFrame, data: DataFrame) -> DataFrame:
    return counts.join(F.broadcast(data.agg(F.count(F.lit(1)).alias("n"))), how="cross")  # one row


def labels_priors(data: DataFrame, dense: bool = True) -> DataFrame:
    c = with_row_count(count_labels(data, dense), data)
    return c.select("label", (F.col("cnt") / F.col("n")).alias("prior"))


def inverse_labels_priors(data: DataFrame, dense: bool = True) -> DataFrame:
    c = with_row_count(count_labels(data, dense), data)
    return c.select("label", F.when(F.col("cnt") == 0, F.lit(float("inf"))).otherwise(F.try_divide("n", "cnt")).alias("inv_prior"))


def jain_inverse_propensity(data: DataFrame, a: float = 0.55, b: float = 1.5, dense: bool = True) -> DataFrame:
    """``label, inv_ps`` with ``1 + (ln n - 1) (b + 1)^a (cnt + b)^-a``."""
    c = with_row_count(count_labels(data, dense), data)
    scale = (F.log(F.col("n").cast("double")) - 1.0) * (b + 1) ** a
    return c.select("label", (1.0 + scale * F.pow(F.col("cnt") + b, F.lit(-a))).alias("inv_ps"))


def jain_propensity(data: DataFrame, a: float = 0.55, b: float = 1.5, dense: bool = True) -> DataFrame:
    return jain_inverse_propensity(data, a, b, dense).select("label", (1.0 / F.col("inv_ps")).alias("ps"))


def label_feature_matrix(data: DataFrame, norm: bool = True, weighted: bool = False) -> DataFrame:
    """``label, idx, val``: the sum of features over a label's rows.

    ``weighted`` divides a row by its number of entries (bias included), ``norm``
    makes each label a unit vector, otherwise sums are divided by the label's rows.
    The label and feature arrays of a row are exploded together: no join, and sums
    are combined before the one shuffle on (label, idx).
    """
    w = F.col("f.val") / (F.size("features") + 1) if weighted else F.col("f.val")
    long = data.select(F.array_distinct(F.array_compact("labels")).alias("labels"), "features").select(F.explode("labels").alias("label"), "features")
    val = long.select("label", "features", F.explode("features").alias("f")).select("label", F.col("f.idx").alias("idx"), w.alias("val"))
    total = val.groupBy("label", "idx").agg(F.sum("val").alias("val"))
    if norm:
        length = total.groupBy("label").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("l"))
        return total.join(length, "label").select("label", "idx", F.when(F.col("l") == 0, F.col("val")).otherwise(F.try_divide("val", "l")).alias("val"))
    return total.join(count_labels(data, dense=False), "label").select("label", "idx", (F.col("val") / F.col("cnt")).alias("val"))
