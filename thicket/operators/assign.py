"""Which binary problem sees which row, with which 0/1 target.

All assignments are joins of exploded labels with tree relations whose size follows
the number of labels; none is broadcast by hand, Spark decides by their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labels import label_rows
from .trees import ancestor_closure


def positive_nodes(data: DataFrame, tree: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """``row_id, node_id``: every node on the way from the root to one of the row's labels.

    Labels that are not in the tree are skipped.
    """
    closure = closure or ancestor_closure(tree)
    leaves = tree.filter("label <> -1").select("label", "node_id")
    # one lookup table label -> ancestors keeps the row side to a single join
    up = leaves.join(closure, "node_id").select("label", F.col("ancestor_id").alias("node_id"))
    return label_rows(data).join(up, "label").select("row_id", "node_id").distinct()


def nodes_to_update(data: DataFrame, tree: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """``row_id, node_id, y``: path nodes 1, their other children 0; a row without known labels (root, 0)."""
    pos = positive_nodes(data, tree, closure)
    kids = tree.filter("parent_id <> -1").select(F.col("parent_id").alias("node_id"), F.col("node_id").alias("_kid"))
    seen = pos.join(kids, "node_id").select("row_id", F.col("_kid").alias("node_id"))
    root = tree.filter("parent_id = -1").select("node_id")
    # a positive node is 1 and a child that is not positive 0: one aggregate instead of an anti join
    both = pos.select("row_id", "node_id", F.lit(1).alias("y")).unionByName(seen.select("row_id", "node_id", F.lit(0).alias("y")))
    path = both.groupBy("row_id", "node_id").agg(F.max("y").alias("y"))
    none = data.select("row_id").join(pos.select("row_id").distinct(), "row_id", "left_anti").join(F.broadcast(root), how="cross").select("row_id", "node_id", F.lit(0).alias("y"))
    return path.unionByName(none)


def sibling_groups(data: DataFrame, tree: DataFrame) -> DataFrame:
    """``parent_id, row_id, hits``: ``nodes_to_update`` by parents, with the positive ones of a parent's children.

    A row is in the problems of all children of a parent or of none, so the pairs need
    not be formed.  The root's own parent is -1; rows without known labels are in it alone.
    """
    pos = positive_nodes(data, tree).join(tree.select("node_id", "parent_id"), "node_id")
    met = pos.groupBy("parent_id", "row_id").agg(F.collect_list("node_id").alias("hits"))
    none = data.select("row_id").join(met.filter("parent_id = -1").select("row_id"), "row_id", "left_anti")
    return met.unionByName(none.select(F.lit(-1).alias("parent_id"), "row_id", F.array().cast("array<int>").alias("hits")))


def nodes_updates(data: DataFrame, tree: DataFrame) -> DataFrame:
    """The same relation seen from nodes; nodes that no row reaches have null row and target."""
    return tree.select("node_id").join(nodes_to_update(data, tree), "node_id", "left")


def br_assignment(data: DataFrame, labels: DataFrame) -> DataFrame:
    """Positives only, ``node_id (= label), row_id``: every other row of a label is a negative."""
    return label_rows(data).join(labels.select("label"), "label", "left_semi").select(F.col("label").alias("node_id"), "row_id")


def ovr_assignment(data: DataFrame, pick_one: bool = True) -> DataFrame:
    """``row_id, label, weight``: with ``pick_one`` a row counts once for each label at 1/size."""
    d = data.select("row_id", F.array_distinct(F.array_compact("labels")).alias("labels"))
    if not pick_one and d.filter(F.size("labels") > 1).take(1):
        raise ValueError("rows with several labels need pick-one weighting")
    return d.select("row_id", F.explode("labels").alias("label"), F.try_divide(F.lit(1.0), F.size("labels")).alias("weight"))


def child_positions(tree: DataFrame) -> DataFrame:
    """``node_id, parent_id, child_pos, n_children`` by node id, counted within each parent."""
    w = Window.partitionBy("parent_id").orderBy("node_id")
    n = Window.partitionBy("parent_id")
    return tree.filter("parent_id <> -1").select("node_id", "parent_id", (F.row_number().over(w) - 1).alias("child_pos"), F.count(F.lit(1)).over(n).alias("n_children"))


def hsm_assignment(data: DataFrame, tree: DataFrame, pick_one: bool = True) -> DataFrame:
    """``row_id, node_id, y, weight`` of hierarchical softmax, one path a label.

    Under a parent with two children only the first is trained, with more all of
    them one against the rest; an only child and the root are always positive.
    A label that is not in the tree raises ValueError.
    """
    rows = ovr_assignment(data, pick_one)
    leaves = tree.filter("label <> -1").select("label", "node_id")
    if rows.select("label").distinct().join(leaves, "label", "left_anti").take(1):
        raise ValueError("a label is not in the tree")
    up = leaves.join(ancestor_closure(tree), "node_id").select("label", F.col("ancestor_id").alias("on"))
    path = rows.join(up, "label").select("row_id", "label", "weight", "on")
    kids = child_positions(tree)
    me = kids.select(F.col("node_id").alias("on"), F.col("parent_id").alias("p"), "n_children")
    at = path.join(me, "on", "left")
    root = at.filter("p is null").select("row_id", F.col("on").alias("node_id"), F.lit(1).alias("y"), "weight")
    sib = kids.select(F.col("parent_id").alias("p"), "node_id", "child_pos")
    below = at.filter("p is not null").join(sib, "p").filter((F.col("n_children") != 2) | (F.col("child_pos") == 0))
    return root.unionByName(below.select("row_id", "node_id", (F.col("node_id") == F.col("on")).cast("int").alias("y"), "weight"))


def _next_prime(n: int) -> int:
    n += 1
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def mach_hashes(m: int, hashes: int = 10, buckets: int = 100, seed: int = 42) -> list[tuple[int, int]]:
    """``(a, b)`` primes of ``label -> a * label mod b mod buckets``, drawn by md5 of the seed."""
    import hashlib

    draw = lambda x: int(hashlib.md5(f"{seed}:{x}".encode()).hexdigest()[:12], 16) % max(m, 1)
    return [(_next_prime(draw(f"a{i}")), _next_prime(buckets + draw(f"b{i}"))) for i in range(hashes)]


def mach_buckets(labels: DataFrame, family: list[tuple[int, int]], buckets: int = 100) -> DataFrame:
    """``label, hash_no, bucket`` for each hash of the family."""
    h = F.array(*[F.struct(F.lit(i).alias("hash_no"), ((F.lit(a).cast("bigint") * F.col("label")) % b % buckets).cast("int").alias("bucket")) for i, (a, b) in enumerate(family)])
    return labels.select("label", F.explode(h).alias("h")).select("label", "h.hash_no", "h.bucket")


def mach_assignment(data: DataFrame, family: list[tuple[int, int]], buckets: int = 100) -> DataFrame:
    """``row_id, hash_no, bucket, y = 1``: buckets that any of the row's labels falls in."""
    rows = label_rows(data)
    h = F.array(*[F.struct(F.lit(i).alias("hash_no"), ((F.lit(a).cast("bigint") * F.col("label")) % b % buckets).cast("int").alias("bucket")) for i, (a, b) in enumerate(family)])
    return rows.select("row_id", F.explode(h).alias("h")).select("row_id", "h.hash_no", "h.bucket").distinct().withColumn("y", F.lit(1))


def estimator_stats(assignment: DataFrame, rows: DataFrame) -> DataFrame:
    """``updates, updates_per_row``: node estimators touched for each data point."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return assignment.agg(F.count(F.lit(1)).alias("updates")).join(n, how="cross").select("updates", F.try_divide("updates", "n").alias("updates_per_row"))
