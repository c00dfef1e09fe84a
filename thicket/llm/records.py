"""Delivered rows of data points to one record per row_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def records(data_points: DataFrame, *columns: str) -> DataFrame:
    """One row per distinct ``row_id`` with the asked columns of its newest delivery.

    Columns: ``labels`` (distinct, sorted, without nulls), ``label_list`` and
    ``feature_list`` (as delivered), ``features`` (distinct sorted feature ids),
    ``subset`` (trimmed, lower case), ``dataset_id``.  Equal ``loaded_at``: the
    greatest row by value.  Rows with a null row_id are no record.  Null arrays
    stay null in the lists and become empty in the sets.
    """
    source = {
        "labels": F.col("labels"), "label_list": F.col("labels"), "feature_list": F.col("features.idx"),
        "features": F.col("features.idx"), "subset": F.lower(F.trim("subset")), "dataset_id": F.col("dataset_id"),
    }
    need = [c for c in source if c in columns]
    one = data_points.filter("row_id is not null").select(F.col("row_id").alias("rec"), "loaded_at", *[source[c].alias(c) for c in need])
    newest = one.groupBy("rec").agg(F.max(F.struct("loaded_at", *need)).alias("r")).select("rec", *[f"r.{c}" for c in need])
    empty = F.array().cast("array<int>")
    for c in ("labels", "features"):
        if c in need:
            newest = newest.withColumn(c, F.coalesce(F.array_sort(F.array_distinct(F.array_compact(c))), empty))
    return newest
