"""Parent-child rows of unknown depth to full hierarchies, with cycle detection.

Plan: a fixed share of the nodes, chosen by a hash of their key, are *splitters*
(roots always are).  Every node is walked to its next splitter above (pointer
doubling, one join of the unfinished walks per round), the far smaller graph of
splitters is solved the same way, and each node's exact path is its splitter's
path followed by its own walk.  Walks that close on themselves without meeting a
splitter are the splitterless cycles; they end at once and are labelled apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stages import drop_stage, is_empty, write_stage

SPLIT_EVERY = 4


def counting_parents(nodes: DataFrame) -> DataFrame:
    """Rows of ``nodes`` -> ``(t, n, par)``, one per node, ``par`` null for roots.

    The newest ``updated_at`` of a (tree_id, node_id) counts; of equally new rows
    the greatest by value.  Null tree or node ids name no node and are left out.  A
    null parent is looked up among the counting rows' ``children`` (the smallest
    node that lists it); -1 or a parent that is not in the tree makes a root.
    Extra columns are ignored.
    """
    rows = nodes.select(
        F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.struct("updated_at", F.col("parent_id").alias("p"), F.col("children").alias("c")).alias("r")
    ).filter("t is not null and n is not null")
    base = write_stage(rows.groupBy("t", "n").agg(F.max("r").alias("r")).select("t", "n", "r.p", "r.c"), "nodes")
    # only nodes without a parent link need the children side
    listed = base.select("t", F.explode("c").alias("n"), F.col("n").alias("_by")).filter("n is not null")
    orphans = base.filter("p is null").select("t", "n")
    found = listed.join(orphans, ["t", "n"], "left_semi").groupBy("t", "n").agg(F.min("_by").alias("p2"))
    linked = base.filter("p is not null and p <> -1").select("t", "n", "p")
    late = orphans.join(found, ["t", "n"], "left")
    known = base.select("t", F.col("n").alias("p"), F.lit(True).alias("_known"))
    checked = linked.join(known, ["t", "p"], "left").select("t", "n", F.when(F.col("_known"), F.col("p")).alias("par"))
    return checked.unionByName(late.select("t", "n", F.col("p2").alias("par"))).unionByName(
        base.filter("p = -1").select("t", "n", F.lit(None).cast("int").alias("par"))
    )


def _loops(start: Column, seg: Column) -> Column:
    return F.array_contains(seg, start) | (F.size(F.array_distinct(seg)) < F.size(seg))


def _double(cur: DataFrame, name: str) -> DataFrame:
    """Repeat over ``(t, n, to, seg, loop, live)``: live rows append the walk of ``to`` to their own.

    ``seg`` holds the nodes above ``n`` from the nearest to ``to``.  A row stops
    being live when ``to`` is an end, or when its walk has closed (``loop``).
    """
    while not is_empty(cur.filter("live")):
        far = cur.select("t", F.col("n").alias("to"), F.col("to").alias("_to"), F.col("seg").alias("_seg"), F.col("live").alias("_live"), F.col("loop").alias("_loop"))
        seg = F.concat("seg", "_seg")
        moved = cur.filter("live").join(far, ["t", "to"]).select(
            "t", "n", F.col("_to").alias("to"), seg.alias("seg"),
            (F.col("_loop") | _loops(F.col("n"), seg)).alias("loop"), F.col("_live").alias("live"),
        ).withColumn("live", F.col("live") & ~F.col("loop"))
        new = write_stage(cur.filter("not live").unionByName(moved), name)
        drop_stage(cur)
        cur = new
    return cur


def _walk_to_splitters(nodes: DataFrame, split_every: int):
    """``(roots, walks, splitters)``: every node's walk to the next splitter above it.

    ``walks(t, n, to, seg, live, loop)`` has all nodes but the roots; ``loop`` marks the
    ones that run into a splitterless cycle.  ``splitters`` are keys only.
    """
    par = counting_parents(nodes)
    split = (F.pmod(F.xxhash64("t", "n"), F.lit(split_every)) == 0) | F.col("par").isNull()
    p = write_stage(par.select("t", "n", "par", split.alias("split")), "parents")
    up = p.select("t", F.col("n").alias("par"), F.col("split").alias("_psplit"))
    step = p.filter("par is not null").join(up, ["t", "par"])
    own = F.col("n") == F.col("par")
    first = step.select("t", "n", F.col("par").alias("to"), F.array("par").alias("seg"), own.alias("loop"), (~F.col("_psplit") & ~own).alias("live"))
    return p.filter("par is null").select("t", "n"), _double(write_stage(first, "walks"), "walks"), p.filter("split").select("t", "n")


def _reduced(roots: DataFrame, walks: DataFrame, splitters: DataFrame) -> DataFrame:
    """The pointer graph of the splitters: live until they point to a root; looping walks are ends."""
    rootmark = roots.select("t", F.col("n").alias("to"), F.lit(True).alias("_root"))
    own = F.col("n") == F.col("to")
    live = F.col("_root").isNull() & ~F.col("loop") & ~own
    return walks.join(splitters, ["t", "n"], "left_semi").join(rootmark, ["t", "to"], "left").select("t", "n", "to", "seg", (F.col("loop") | own).alias("loop"), live.alias("live"))


def hierarchy(nodes: DataFrame, split_every: int = SPLIT_EVERY) -> DataFrame:
    """One row per node: ``tree_id, node_id, root_id, depth, path, status, walk``.

    ``path`` runs from the root to the node itself; ``depth`` of a root is 0.  Nodes
    that never reach a root have root_id -1, null depth and path, and status
    'cycle' if they lie on the circle or 'below_cycle' if they only lead into it.
    ``walk`` is null but for these: the other nodes met going up from the node,
    nearest first and each once, the whole circle included.
    An empty table gives an empty result.
    """
    roots, walks, splitters = _walk_to_splitters(nodes, split_every)
    solved = _double(write_stage(_reduced(roots, walks, splitters), "splitters"), "splitters")
    top = solved.select("t", F.col("n").alias("to"), F.col("to").alias("_root"), F.col("seg").alias("_up"), F.col("loop").alias("_loop"))
    # walks that end in a root need no join; the others take their splitter's path
    rootmark = roots.select("t", F.col("n").alias("to"), F.lit(True).alias("_at_root"))
    ended = walks.filter("not loop").join(rootmark, ["t", "to"], "left")
    direct = ended.filter("_at_root").select("t", "n", F.col("to").alias("root"), "seg", F.lit(False).alias("loop"))
    via = ended.filter("_at_root is null").join(top, ["t", "to"]).select(
        "t", "n", F.col("_root").alias("root"), F.concat("seg", "_up").alias("seg"), F.col("_loop").alias("loop")
    )
    alone = walks.filter("loop").select("t", "n", F.col("to").alias("root"), "seg", "loop")
    every = direct.unionByName(via).unionByName(alone).unionByName(
        roots.select("t", "n", F.col("n").alias("root"), F.array().cast("array<int>").alias("seg"), F.lit(False).alias("loop"))
    )
    on = F.array_contains("seg", F.col("n"))
    path = F.reverse(F.concat(F.array("n"), F.col("seg")))
    return every.select(
        F.col("t").alias("tree_id"), F.col("n").alias("node_id"),
        F.when(F.col("loop"), F.lit(-1)).otherwise(F.col("root")).alias("root_id"),
        F.when(~F.col("loop"), F.size("seg")).alias("depth"),
        F.when(~F.col("loop"), path).alias("path"),
        F.when(~F.col("loop"), "tree").when(on, "cycle").otherwise("below_cycle").alias("status"),
        F.when(F.col("loop"), F.array_remove(F.array_distinct("seg"), F.col("n"))).alias("walk"),
    )


def descendants(tree: DataFrame) -> DataFrame:
    """Closure of ``hierarchy``: ``tree_id, node_id, descendant_id, distance`` for every proper descendant.

    A descendant of a node is any other node from which going up meets it; ``distance``
    is the number of links until it is first met.  Nodes that never reach a root count
    too: on a circle each node is below all the others, and what hangs below a circle
    is below all its nodes.  No node is its own descendant.
    """
    above = F.coalesce(F.slice(F.reverse("path"), F.lit(2), F.size("path")), "walk")
    h = tree.select("tree_id", F.col("node_id").alias("descendant_id"), F.posexplode(above).alias("_i", "node_id"))
    return h.select("tree_id", "node_id", "descendant_id", (F.col("_i") + 1).alias("distance"))
