"""Pointer and component programs over large graphs kept as DataFrames.

Both loops shrink geometrically: pointers double in reach with each round, and
components hook onto smaller labels and jump.  State is a narrow stage table per
round; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import drop_stage, is_empty, write_stage


def resolve_pointers(ptr: DataFrame) -> DataFrame:
    """``ptr(node, to)``, acyclic but for ends with ``to = node`` -> ``(node, end)``.

    Every ``to`` must itself be a node.  ``log2(longest chain)`` rounds, each one
    join of the still moving pointers.
    """
    cur = write_stage(ptr.select("node", "to"), "pointers")
    while True:
        nxt = cur.select(F.col("node").alias("to"), F.col("to").alias("_far"))
        out = cur.join(nxt, "to", "left").select(
            "node", F.coalesce("_far", "to").alias("to"), F.coalesce(F.col("_far") != F.col("to"), F.lit(False)).alias("_moved")
        )
        new = write_stage(out, "pointers")
        drop_stage(cur)
        if is_empty(new.filter("_moved")):
            return new.select("node", F.col("to").alias("end"))
        cur = new.select("node", "to")
        cur._thicket_stage = new._thicket_stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)``, component the smallest node in it.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): each
    round rewires neighbours to the smallest one it knows, which keeps the edge
    count from growing.  Stars of any size are aggregated by ``min`` with map-side
    combining, so a hub is never gathered in one place.
    """
    # The caller's (often costly) edge plan is evaluated once, then symmetric dedup.
    cur = write_stage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    first = cur
    while True:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # large star: every larger neighbour of u points to the smallest of u's neighbourhood
        big = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        big = write_stage(big, "edges")
        # small star: the smaller neighbours of u and u itself point to the smallest
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        j = big.join(least, "u")
        small = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = write_stage(small, "edges")
        same = is_empty(new.exceptAll(cur)) and is_empty(cur.select("u", "v").exceptAll(new))
        drop_stage(big)
        if cur is not first:
            drop_stage(cur)
        cur = new
        if same:
            break
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
