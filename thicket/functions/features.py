"""Sparse feature vectors as ``array<struct<idx:int,val:double>>`` columns.

All are array expressions evaluated in place; none shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIAS = -1  # reserved index of the bias entry, so that real indexes are never shifted
#: 32-bit FNV-1a, and the shift that indexes have when they are hashed.
FNV_OFFSET, FNV_PRIME, HASH_SHIFT = 2166136261, 16777619, 2


def _pair(idx: Column, val: Column) -> Column:
    return F.struct(idx.cast("int").alias("idx"), val.cast("double").alias("val"))


def clean(features: Column) -> Column:
    """Without null members, indexes and values; a null array becomes empty."""
    empty = F.array().cast("array<struct<idx:int,val:double>>")
    return F.coalesce(F.filter(features, lambda f: f.isNotNull() & f["idx"].isNotNull() & f["val"].isNotNull()), empty)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _add_up(srt: Column) -> Column:
    """Neighbours with equal index of a sorted vector become their sum, in one fold."""
    start = F.struct(F.slice(srt, 1, 0).alias("done"), F.get(srt, F.lit(0)).alias("last"))

    def step(acc, f):
        same = acc["last"]["idx"] == f["idx"]
        return F.struct(
            F.when(same, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))).alias("done"),
            F.when(same, _pair(f["idx"], acc["last"]["val"] + f["val"])).otherwise(f).alias("last"),
        )

    return F.aggregate(F.slice(srt, F.lit(2), F.greatest(F.size(srt) - 1, F.lit(0))), start, step, lambda acc: F.concat(acc["done"], F.array(acc["last"])))


def combine(features: Column) -> Column:
    """Sorted by index, with the values of a repeated index added up, zeros dropped."""
    distinct = lambda s: F.size(F.array_distinct(F.transform(s, lambda f: f["idx"]))) == F.size(s)
    summed = let(F.array_sort(clean(features)), lambda s: F.when(distinct(s), s).otherwise(_add_up(s)))
    return F.filter(summed, lambda f: f["val"] != 0)


def add_bias(features: Column, bias: float = 1.0) -> Column:
    return F.concat(F.array(_pair(F.lit(BIAS), F.lit(bias))), features)


def shift(features: Column, by: int = HASH_SHIFT) -> Column:
    return F.transform(features, lambda f: F.when(f["idx"] == BIAS, f).otherwise(_pair(f["idx"] + by, f["val"])))


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a over the four little-endian bytes of an int, as long."""
    byte = lambda s: F.shiftright(x.cast("bigint"), s).bitwiseAND(F.lit(255))
    h = F.lit(FNV_OFFSET).cast("bigint")
    for s in (0, 8, 16, 24):
        h = (h.bitwiseXOR(byte(s)) * F.lit(FNV_PRIME).cast("bigint")).bitwiseAND(F.lit(4294967295))
    return h


def hash_features(features: Column, buckets: int) -> Column:
    """Hash the shifted indexes into ``buckets``; values that meet add up."""
    return combine(F.transform(features, lambda f: _pair((fnv1a(f["idx"] + HASH_SHIFT) % buckets) + HASH_SHIFT, f["val"])))


def l2_norm(features: Column) -> Column:
    return F.sqrt(F.aggregate(features, F.lit(0.0), lambda a, f: a + F.when(f["idx"] == BIAS, 0.0).otherwise(f["val"] * f["val"])))


def unit_norm(features: Column) -> Column:
    """Divided by the length without the bias; a zero vector stays as it is."""
    scaled = lambda f, n: F.transform(f, lambda e: F.when((n == 0) | (e["idx"] == BIAS), e).otherwise(_pair(e["idx"], F.try_divide(e["val"], n))))
    return let(features, lambda f: let(l2_norm(f), lambda n: scaled(f, n)))


def threshold_abs(features: Column, t: float) -> Column:
    """Without entries of ``abs(val) <= t``; the bias stays."""
    return F.filter(features, lambda f: (F.abs(f["val"]) > t) | (f["idx"] == BIAS))


def prepare(features: Column, bias: float = 1.0, norm: bool = True, hash_size: int = 0, threshold: float = 0.0) -> Column:
    """The fixed order: clean, hash, norm, threshold, sort, bias in front."""
    f = hash_features(features, hash_size) if hash_size else combine(features)
    f = unit_norm(f) if norm else f
    f = threshold_abs(f, threshold) if threshold > 0 else f
    return add_bias(f, bias) if bias > 0 else f


def dense_to_sparse(values: Column) -> Column:
    """An array of numbers to its non-zero entries."""
    return F.filter(F.transform(values, lambda v, i: _pair(i, v)), lambda f: f["val"] != 0)


def _lookup(features: Column) -> Column:
    return F.map_from_arrays(F.transform(features, lambda f: f["idx"]), F.transform(features, lambda f: f["val"]))


def sparse_to_dense(features: Column, size: int) -> Column:
    return let(_lookup(features), lambda m: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))))


def dot(a: Column, b: Column) -> Column:
    """Of two sparse vectors with distinct indexes."""
    return let(_lookup(b), lambda m: F.aggregate(a, F.lit(0.0), lambda s, f: s + f["val"] * F.coalesce(F.try_element_at(m, f["idx"]), F.lit(0.0))))


def dot_dense(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def scale(features: Column, by: Column | float) -> Column:
    return F.transform(features, lambda f: _pair(f["idx"], f["val"] * by))


def add(a: Column, b: Column) -> Column:
    return combine(F.concat(a, b))


def subtract(a: Column, b: Column) -> Column:
    return combine(F.concat(a, scale(b, -1.0)))


def divide(features: Column, by: Column | float) -> Column:
    """Divided by a number; by zero every value is null and the vector empty."""
    return F.filter(F.transform(features, lambda f: _pair(f["idx"], F.try_divide(f["val"], F.lit(by) if isinstance(by, (int, float)) else by))), lambda f: f["val"].isNotNull())


def invert(features: Column) -> Column:
    """1 / value of every entry; entries are never zero."""
    return F.transform(features, lambda f: _pair(f["idx"], F.try_divide(F.lit(1.0), f["val"])))


def axpy(a: Column, by: Column | float, b: Column) -> Column:
    """``a + by * b``."""
    return combine(F.concat(a, scale(b, by)))


def zero_at(features: Column, idx: Column | int) -> Column:
    """Without the entry of an index."""
    return F.filter(features, lambda f: f["idx"] != idx)


def prune_weights(weights: Column, t: float = 0.1) -> Column:
    return threshold_abs(weights, t)
