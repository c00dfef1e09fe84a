"""Load text lines of several formats; set apart the ones that fail, with reasons.

Every line is kept as nullable text.  Cast and constraint rules are evaluated
column-wise into an array of reasons; a line is loaded exactly when that array is
empty.  All rules of the space separated formats are JVM expressions over split
fields; only JSON lines go through an Arrow function, because Spark's JSON reader
accepts more than the standard does.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ID = 2147483647
ID = r"[0-9]{1,10}"
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def _whole(c: Column, pattern: str) -> Column:
    return c.rlike(r"\A(?:" + pattern + r")\z")


def _is_id(c: Column) -> Column:
    return F.coalesce(_whole(c, ID) & (c.try_cast("bigint") <= MAX_ID), F.lit(False))


def _is_number(c: Column) -> Column:
    v = c.try_cast("double")
    return F.coalesce(_whole(c, NUMBER) & (F.abs(v) < float("inf")), F.lit(False))


def _is_pair(f: Column) -> Column:
    k = F.instr(f, ":")
    return (k > 0) & _is_id(F.substring(f, F.lit(1), k - 1)) & _is_number(F.substring(f, k + 1, F.length(f)))


def _reason(bad: Column, name: str) -> Column:
    return F.when(bad, F.lit(name))


_JSON = T.StructType(
    [
        T.StructField("errors", T.ArrayType(T.StringType())),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("target_ind", T.ArrayType(T.IntegerType())),
        T.StructField("n_target", T.IntegerType()),
    ]
)


def _json_line(line: str) -> tuple:
    """Strict RFC 8259: no NaN, no control characters, nothing after the object."""

    def refuse(_):
        raise ValueError

    def whole(s: str) -> int:
        return int(s) if len(s) <= 12 else MAX_ID + 1

    try:
        v = json.loads(line, parse_constant=refuse, parse_int=whole)
    except (ValueError, RecursionError):
        return ["json_syntax"], None, None, None, None
    if not isinstance(v, dict):
        return ["json_not_object"], None, None, None, None
    errors = []
    for k in ("title", "content"):
        if not isinstance(v.get(k), str):
            errors.append(f"json_{k}")
    t = v.get("target_ind")
    if not isinstance(t, list) or any(type(x) is not int or not 0 <= x <= MAX_ID for x in t):
        errors.append("json_target_ind")
    if errors:
        return errors, None, None, None, len(t) if isinstance(t, list) else None
    clean = [x.encode("utf-8", "replace").decode("utf-8") for x in (v["title"], v["content"])]  # lone surrogates can't be stored
    return [], clean[0], clean[1], t, len(t)


@F.pandas_udf(_JSON)
def _json_fields(lines: pd.Series) -> pd.DataFrame:
    rows = [(None,) * 5 if x is None else _json_line(x) for x in lines]
    return pd.DataFrame(rows, columns=["errors", "title", "content", "target_ind", "n_target"])


def validate_lines(lines: DataFrame, registry: DataFrame) -> DataFrame:
    """Parse ``lines.line`` by the ``file_format`` its data set has in ``registry``.

    Returns one row per line: ``line_id, dataset_id, file_format, labels, features,
    title, content, parent_id, node_id, label, errors``; parsed columns are null
    where ``errors`` is not empty.  A null line, a data set that is null or not in
    the registry, and an unknown format are errors.  Repeated registry ids: the
    first format by name counts.  No quoting exists in these formats but JSON's.
    """
    raw = lines.select("line_id", "dataset_id", F.col("declared_count").cast("long").alias("declared"), "line")
    formats = registry.groupBy("dataset_id").agg(F.min("file_format").alias("file_format"))
    d = raw.join(formats, "dataset_id", "left").withColumn("_t", F.rtrim(F.col("line"), F.lit(" \r")))
    fmt = F.coalesce("file_format", F.lit(""))
    text = fmt.isin("libsvm", "XY_sparse", "tree_text")
    d = d.withColumn("_f", F.when(text, F.split("_t", " +")))
    # a JSON line goes to Python; every other row sends it a null
    d = d.withColumn("_j", _json_fields(F.when(fmt == "jsonlines", F.col("line"))))
    empty = F.col("_t") == ""
    head, tail = F.get("_f", F.lit(0)), F.when(F.size("_f") > 1, F.slice("_f", F.lit(2), F.size("_f"))).otherwise(F.array().cast("array<string>"))
    labels = F.when(head == "", F.array().cast("array<string>")).otherwise(F.split(head, ","))
    xy = F.when(empty, F.array().cast("array<string>")).otherwise(F.col("_f"))
    d = d.withColumn("_labels", F.when(fmt == "libsvm", labels)).withColumn("_feats", F.when(fmt == "libsvm", tail).when(fmt == "XY_sparse", xy))
    n = F.size("_f")
    tree = fmt == "tree_text"
    link = lambda c: _is_id(c) | F.coalesce(c == "-1", F.lit(False))
    counted = F.when(fmt == "jsonlines", F.col("_j.n_target")).otherwise(F.when(F.col("_feats").isNotNull(), F.size("_feats")))
    errors = F.array_compact(
        F.array(
            _reason(F.col("line").isNull(), "null_line"),
            _reason(~text & (fmt != "jsonlines"), "unknown_format"),
            _reason(~F.forall("_labels", _is_id), "bad_label"),
            _reason((fmt == "libsvm") & ~F.forall("_feats", lambda f: _is_id(f) | _is_pair(f)), "bad_feature"),
            _reason((fmt == "XY_sparse") & ~F.forall("_feats", _is_pair), "bad_feature"),
            _reason(tree & ~n.isin(2, 3), "field_count"),
            _reason(tree & n.isin(2, 3) & ~link(F.get("_f", F.lit(0))), "bad_parent"),
            _reason(tree & n.isin(2, 3) & ~_is_id(F.get("_f", F.lit(1))), "bad_node"),
            _reason(tree & (n == 3) & ~link(F.get("_f", F.lit(2))), "bad_tree_label"),
            _reason(F.col("declared").isNotNull() & (F.col("declared") != counted), "declared_count"),
        )
    )
    errors = F.concat(errors, F.coalesce("_j.errors", F.array().cast("array<string>")))
    d = d.withColumn("errors", errors)
    ok = F.size("errors") == 0
    pair = T.ArrayType(T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("val", T.DoubleType())]))
    feats = F.transform(
        "_feats",
        lambda f: F.struct(F.substring_index(f, ":", 1).try_cast("int").alias("idx"), F.when(F.instr(f, ":") > 0, F.substring_index(f, ":", -1).try_cast("double")).otherwise(1.0).alias("val")),
    )
    part = lambda i: F.when(ok & tree, F.get("_f", F.lit(i)).try_cast("int"))
    return d.select(
        "line_id", "dataset_id", "file_format",
        F.when(ok, F.coalesce(F.transform("_labels", lambda x: x.try_cast("int")), "_j.target_ind")).alias("labels"),
        F.when(ok, feats).cast(pair).alias("features"),
        F.when(ok, F.col("_j.title")).alias("title"), F.when(ok, F.col("_j.content")).alias("content"),
        part(0).alias("parent_id"), part(1).alias("node_id"), part(2).alias("label"), "errors",
    )


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(loaded rows, rejected rows with their errors)``: disjoint, and together all lines."""
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0).select("line_id", "dataset_id", "file_format", "errors")
