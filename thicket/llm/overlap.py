"""The same or nearly the same records in different splits.

Fingerprint: every feature id flips one bit of a 64-bit code (an odd sketch), so two
codes differ in at most as many bits as their feature sets differ in members.  Two
sets of Jaccard similarity J or more whose larger one has m members differ in at
most d(m) members; with the members hashed into d + 2 segments, the code blocks of
at least two segments must be equal.  Records are therefore joined across splits on
every pair of segments (on single ones of d + 1 where d is large), candidates are
kept within the Hamming radius d, and the feature sets themselves are compared
last.  No similar pair is lost, whatever the hash.  Sizes are banded so that d fits
the sets: a record is indexed in its own band and, as the smaller partner, in the
next one.

Records with exactly equal sets enter the join once, as a class; classes found
similar are expanded through the membership table.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import write_stage

HOT_SALT = 8
MOST_PAIRED = 8  # largest radius for which pairs of segments are used


def max_difference(m: int, threshold: float, least: int) -> int:
    """Most members in which sets of at least ``threshold`` Jaccard can differ, the larger having ``m``."""
    worst = 0
    for b in range(max(least, math.ceil(threshold * m - 1e-9)), m + 1):
        common = math.ceil(threshold * (m + b) / (1 + threshold) - 1e-9)
        if common <= b:
            worst = max(worst, m + b - 2 * common)
    return worst


def band_top(i: int, least: int, threshold: float) -> int:
    """Largest set size of band ``i``; a partner of a set in band i lies in band i or i - 1."""
    top = least
    for _ in range(i):
        top = max(top + 1, math.floor((top + 1) / threshold + 1e-9) - 1)
    return top


def _code_blocks(sets: DataFrame, threshold: float, least: int) -> DataFrame:
    """``cls, items`` -> a row for each band and pair of segments: block key, radius, code and size."""

    def blocks(batches):
        import numpy as np

        tops = [least]
        diffs: dict[int, int] = {}

        def mix(x, salt):
            with np.errstate(over="ignore"):
                x = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                return x ^ (x >> np.uint64(31))

        for b in batches:
            items = b.column(1)
            width = items.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = items.flatten().to_numpy(zero_copy_only=False)
            start = np.r_[0, np.cumsum(width)[:-1]]
            while len(width) and tops[-1] < width.max():
                tops.append(band_top(len(tops), least, threshold))
            own = np.searchsorted(tops, width)
            one = np.uint64(1) << (mix(flat, 1) & np.uint64(63))
            code = np.bitwise_xor.reduceat(one, start) if len(flat) else one
            where, block = mix(flat, 3), mix(flat, 5)
            for shift in (0, 1):
                band = own + shift
                for v in np.unique(band):
                    v = int(v)
                    if v not in diffs:
                        lo, hi = (0 if v == 0 else band_top(v - 1, least, threshold)) + 1, band_top(v, least, threshold)
                        diffs[v] = max(max_difference(m, threshold, least) for m in range(max(lo, least), hi + 1))
                    d = diffs[v]
                    two = d <= MOST_PAIRED
                    segs = d + 1 + two
                    rows = np.flatnonzero(band == v)
                    n, w = len(rows), width[rows]
                    member = np.repeat(start[rows] - (np.cumsum(w) - w), w) + np.arange(w.sum())
                    content = np.zeros(n * segs, np.uint64)
                    np.bitwise_xor.at(content, np.repeat(np.arange(n) * segs, w) + (where[member] % np.uint64(segs)).astype(np.int64), block[member])
                    content = content.reshape(n, segs)
                    for i in range(segs):
                        for j in range(i + 1, segs) if two else (i,):
                            with np.errstate(over="ignore"):
                                key = mix(content[:, i] + np.uint64(i + 1), 11) ^ mix(content[:, j] + np.uint64((v << 16) + j + 1), 13)
                            take = pa.array(rows)
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(key.view(np.int64)), b.column(0).take(take), pa.array(np.full(n, d, np.int32)), pa.array((content[:, i] == 0) & (content[:, j] == 0)),
                                    pa.array(code[rows].view(np.int64)), pa.array(w.astype(np.int32)),
                                ],
                                names=["key", "cls", "d", "empty", "code", "size"],
                            )

    return sets.mapInArrow(blocks, "key bigint, cls bigint, d int, empty boolean, code bigint, size int")


def similar_across(records: DataFrame, threshold: float = 0.8, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """``records(rec, side, items)`` -> ``(class pairs, membership)``.

    ``items`` are sorted distinct ids, ``side`` is 0 or 1.  Sets smaller than
    ``least`` take no part.  ``membership(cls, rec, side)`` has every record that
    does; ``pairs(cls_a, cls_b, jaccard)`` joins a class holding side 0 with one
    holding side 1, a class with itself if it holds both.
    """
    use = write_stage(records.filter((F.size("items") >= least) & F.col("side").isin(0, 1)).select("rec", F.col("side").cast("int"), "items"), "sets")
    classes = write_stage(
        use.groupBy("items").agg(F.min("rec").alias("cls"), F.max(F.col("side") == 0).alias("has0"), F.max(F.col("side") == 1).alias("has1")), "classes"
    )
    members = use.join(classes.select("items", "cls"), "items").select("cls", "rec", "side")
    # blocks without a member are the ones that many records share: spread them
    left = _code_blocks(classes.filter("has0").select("cls", "items"), threshold, least)
    left = left.withColumn("salt", F.when(F.col("empty"), F.pmod(F.xxhash64("cls"), F.lit(HOT_SALT))).otherwise(0).cast("int"))
    right = _code_blocks(classes.filter("has1").select("cls", "items"), threshold, least)
    right = right.withColumn("salt", F.explode(F.when(F.col("empty"), F.sequence(F.lit(0), F.lit(HOT_SALT - 1))).otherwise(F.array(F.lit(0)))))
    distance = F.bit_count(F.col("l.code").bitwiseXOR(F.col("r.code")))
    small, large = F.least("l.size", "r.size"), F.greatest("l.size", "r.size")
    near = (
        left.alias("l").join(right.alias("r"), ["key", "salt"])
        .filter((F.col("l.d") == F.col("r.d")) & (distance <= F.col("l.d")) & (small >= large * F.lit(threshold - 1e-9)) & (F.col("l.cls") != F.col("r.cls")))
        .select(F.col("l.cls").alias("cls_a"), F.col("r.cls").alias("cls_b")).distinct()
    )
    a = classes.select(F.col("cls").alias("cls_a"), F.col("items").alias("items_a"))
    b = classes.select(F.col("cls").alias("cls_b"), F.col("items").alias("items_b"))
    common = F.size(F.array_intersect("items_a", "items_b"))
    checked = near.join(a, "cls_a").join(b, "cls_b").withColumn("c", common).withColumn("u", F.size("items_a") + F.size("items_b") - F.col("c"))
    # c / u >= threshold in whole numbers of a millionth, free of rounding
    kept = checked.filter(F.col("c").cast("long") * 1000000 >= F.col("u").cast("long") * round(threshold * 1000000))
    pairs = kept.select("cls_a", "cls_b", (F.col("c") / F.col("u")).alias("jaccard"))
    same = classes.filter("has0 and has1").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"), F.lit(1.0).alias("jaccard"))
    return pairs.unionByName(same), members


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Record pairs ``rec_0 (side 0), rec_1 (side 1), jaccard`` behind class pairs."""
    a = members.filter("side = 0").select(F.col("cls").alias("cls_a"), F.col("rec").alias("rec_0"))
    b = members.filter("side = 1").select(F.col("cls").alias("cls_b"), F.col("rec").alias("rec_1"))
    return pairs.join(a, "cls_a").join(b, "cls_b").select("rec_0", "rec_1", "jaccard")


def overlap_report(pairs: DataFrame, members: DataFrame, origin: DataFrame) -> DataFrame:
    """Side 1 records with a partner in side 0, counted per subset and data set.

    ``origin(rec, subset, dataset_id)``.  Works on classes only, so groups of copies
    are never expanded: ``records, exact, near`` (an exact copy is not counted as near).
    """
    best = pairs.groupBy(F.col("cls_b").alias("cls")).agg(F.max("jaccard").alias("best"))
    hit = members.filter("side = 1").join(best, "cls", "left").join(origin, "rec")
    return hit.groupBy("subset", "dataset_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.when(F.col("best") == 1.0, 1).otherwise(0)).alias("exact"),
        F.sum(F.when(F.col("best") < 1.0, 1).otherwise(0)).alias("near"),
    )
