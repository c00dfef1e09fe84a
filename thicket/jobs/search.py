"""Queries of label trees and searches at sizes where they cut, and their SQL.

A deep model is a complete binary tree of 256 leaves whose weights are a formula of
node and index, so SQL can state every score; the plans of large models are forced
by small limits.  Assignment and trees also run over all labels of the data points.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as fx
from ..operators import assign, labels, predict, trees
from ..plans.stages import write_stage
from ..sources import files
from ..streaming import ofo
from .reference import _P, _Q, _V, _hsm_sql, _rows, _scores, _topk, _tree_model, _weights, newest_scores, points, vectors
from .reference import oracle_sql as _reference_sql

LEAVES, LEVELS = 256, 8
SMALL = {"SMALL_MODEL": 0, "BLOCK_WEIGHTS": 4000, "CHUNK_CELLS": 20_000}


def _deep(spark):
    t = trees.complete_tree(spark, LEAVES, 2)
    node, idx = F.col("node_id").cast("long"), F.col("idx")
    w = t.select("node_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("idx")).withColumn("w", ((node * 7919 + idx * 104729) % 1009) / 1009.0 - 0.5)
    return t, predict.given_models(t), w


def plt_beam(spark, d):
    """A beam of 3 over levels of up to 128 inner nodes."""
    return _scores(predict.plt_beam(_rows(spark, d), *_deep(spark), k=3, width=3))


def plt_beam_joins(spark, d):
    with predict.limits(**SMALL):
        return _scores(predict.plt_beam(_rows(spark, d), *_deep(spark), k=3, width=3))


def plt_deep_topk(spark, d):
    return _scores(predict.plt_predict(_rows(spark, d), *_deep(spark), k=3))


def plt_parts_topk(spark, d):
    """The same from a tree cut into parts."""
    with predict.limits(**SMALL):
        return _scores(predict.plt_predict(_rows(spark, d), *_deep(spark), k=3))


def plt_parts_terms(spark, d):
    """Weights, biases and thresholds of labels, pruned by their bounds below each node."""
    lab = spark.range(LEAVES).select(F.col("id").cast("int").alias("label"))
    w, b, t = lab.withColumn("weight", 0.5 + F.col("label") % 5), lab.withColumn("bias", (F.col("label") % 7) / 1000.0), lab.withColumn("threshold", (F.col("label") % 3) / 200.0)
    with predict.limits(**SMALL):
        return _scores(predict.plt_predict(_rows(spark, d), *_deep(spark), k=3, label_thresholds=t, label_weights=w, label_biases=b))


def hsm_parts_topk(spark, d):
    with predict.limits(**{**SMALL, "BLOCK_WEIGHTS": 300}):
        return _scores(predict.hsm_predict(_rows(spark, d), *_tree_model(spark, d, 3), k=3))


def br_blocks_topk(spark, d):
    w = _weights(spark, d)
    with predict.limits(**{**SMALL, "BLOCK_WEIGHTS": 200}):
        return _scores(predict.br_predict(_rows(spark, d), predict.given_models(w.select("node_id").distinct()), w, 3))


def ovr_blocks_topk(spark, d):
    w = _weights(spark, d)
    with predict.limits(**{**SMALL, "BLOCK_WEIGHTS": 200}):
        return _scores(predict.ovr_predict(_rows(spark, d), predict.given_models(w.select("node_id").distinct()), w, 3))


# all labels of the data points ----------------------------------------------------------------
def _label_tree(spark, p):
    return trees.complete_tree(spark, labels.count_labels(p, dense=False).agg(F.max("label")).first()[0] + 1, 16)


def points_nodes_to_update(spark, d):
    """Several paths a row in a tree over all label ids."""
    p = write_stage(points(spark, d).select("row_id", "labels"), "points")
    return assign.nodes_to_update(p, _label_tree(spark, p))


def points_update_stats(spark, d):
    p = write_stage(points(spark, d).select("row_id", "labels"), "points")
    s = assign.estimator_stats(assign.nodes_to_update(p, _label_tree(spark, p)), p)
    return s.select("updates", F.round("updates_per_row", 6).alias("updates_per_row"))


def tree_kmeans(spark, d):
    """Nodes and leaves of each depth in a balanced 2-means tree over all labels: sizes follow from the halving."""
    p = write_stage(points(spark, d), "points")
    t = trees.node_depths(trees.build_tree(spark, "hierarchicalKmeans", p, 2, 100))
    return t.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"), F.sum((F.col("label") != -1).cast("long")).alias("leaves"))


def tree_kmeans_labels(spark, d):
    """Every label is a leaf of the tree once."""
    p = write_stage(points(spark, d), "points")
    return trees.build_tree(spark, "hierarchicalKmeans", p, 3, 50).filter("label <> -1").groupBy("label").agg(F.count(F.lit(1)).alias("leaves"))


def tree_huffman_cost(spark, d):
    """Expected depth of the leaves under their priors, over all labels of the data points."""
    pri = write_stage(labels.labels_priors(points(spark, d), dense=False), "priors")
    t = trees.node_depths(trees.huffman_tree(spark, pri)).filter("label <> -1")
    return t.join(pri, "label").agg(F.round(F.sum(F.col("prior") * (F.col("depth") - 1)), 6).alias("cost"))


def tree_online(spark, d):
    return trees.online_tree(spark, files.first_seen_ids(points(spark, d).select(F.lit(0).alias("file_no"), "row_id", "labels")), 2)


def tree_flatten(spark, d):
    t = trees.node_depths(trees.flatten_tree(trees.complete_tree(spark, 81, 3), 1))
    return t.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"), F.sum((F.col("label") != -1).cast("long")).alias("leaves"))


def tree_random(spark, d):
    """Labels on the leaves of a complete tree in a seeded order."""
    return trees.complete_tree(spark, 1000, 4, seed=7).filter("label <> -1").select("node_id", "label")


def tree_remap(spark, d):
    """Ids with gaps made dense."""
    t = trees.complete_tree(spark, 300, 3)
    gap = lambda c: F.when(F.col(c) < 0, -1).otherwise(F.col(c) * 7 + 5).cast("int").alias(c)
    return trees.remap_tree(t.select(gap("node_id"), gap("parent_id"), "label")).select("node_id", "parent_id", "label")


def tree_distance(spark, d):
    """Two nodes and the one where their paths meet, before and after a subtree has moved."""
    t = trees.complete_tree(spark, 500, 3)
    return trees.node_distance(t, 700, 333).withColumn("moved", F.lit(False)).unionByName(trees.node_distance(trees.move_subtree(t, 8, 1), 700, 333).withColumn("moved", F.lit(True)))


def tree_text_lines(spark, d):
    """A tree written as text and read again."""
    from ..plans.stages import stage_path

    path = stage_path(spark, "treetext")
    t = trees.complete_tree(spark, 200, 5)
    lines = t.select("node_id", trees.tree_line().alias("value")).unionByName(spark.createDataFrame([(-1, "200 250")], "node_id int, value string"))
    lines.repartitionByRange(1, "node_id").sortWithinPartitions("node_id").select("value").write.text(path)
    return trees.read_tree_text(spark, path).select("node_id", "parent_id", "label")


# vectors and thresholds ------------------------------------------------------------------------
def vector_arithmetic(spark, d):
    """Sums of a vector plus half its neighbour, its inverse, its tenth, and itself without index 3."""
    v = vectors(spark, d)
    b = v.select((F.col("row_id") + 1).alias("row_id"), F.col("features").alias("g"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, f: a + f["val"]), 6)
    f = F.col("features")
    return v.join(b, "row_id").select(
        "row_id", total(fx.axpy(f, 0.5, F.col("g"))).alias("axpy"), F.round(F.aggregate(fx.invert(f), F.lit(0.0), lambda a, e: a + e["val"] / (1 + F.abs(e["val"]))), 6).alias("inverse"),
        total(fx.divide(f, 10.0)).alias("tenth"), total(fx.zero_at(f, 3)).alias("rest"))


def feature_pipeline(spark, d):
    """All steps in order: hash, norm, threshold, bias."""
    p = points(spark, d).select("row_id", fx.prepare(F.col("features"), 1.0, True, 1000, 0.1).alias("features"))
    return p.select("row_id", F.explode("features").alias("f")).select("row_id", F.col("f.idx").alias("idx"), F.round("f.val", 6).alias("val"))


def _scored_rows(spark, d):
    """All scored rows of all runs in order, as one fold."""
    s = newest_scores(spark, d).filter("score is not null and not isnan(score)").groupBy("run_id", "row_id").agg(F.collect_list(F.struct("label", "score")).alias("probs"))
    j = s.join(points(spark, d).select("row_id", F.array_distinct(F.array_compact("labels")).alias("labels")), "row_id")
    return write_stage(j.select((F.col("row_id") * 1000 + F.col("run_id")).alias("row_id"), "labels", "probs"), "scored")


def ofo_micro(spark, d):
    return spark.createDataFrame([(round(ofo.micro_ofo(_scored_rows(spark, d)), 6),)], "threshold double")


def ofo_macro_blocks(spark, d):
    """Per-label thresholds in four blocks of rows, one aggregate a block."""
    s = newest_scores(spark, d).filter("score is not null and not isnan(score)")
    y = labels.label_rows(points(spark, d)).withColumn("y", F.lit(1))
    long = s.join(y, ["row_id", "label"], "left").select((F.col("row_id") * 1000 + F.col("run_id")).alias("row_id"), "label", "score", F.coalesce("y", F.lit(0)).alias("y"))
    block = long.select("row_id").distinct().select("row_id", (F.floor(F.col("row_id") / 1000) % 4).cast("int").alias("block"))
    return ofo.macro_ofo_blocks(long, block, 4).select("label", F.round("threshold", 6).alias("threshold"))


_ALL = [
    plt_beam, plt_beam_joins, plt_deep_topk, plt_parts_topk, plt_parts_terms, hsm_parts_topk, br_blocks_topk, ovr_blocks_topk, points_nodes_to_update, points_update_stats,
    tree_kmeans, tree_kmeans_labels, tree_huffman_cost, tree_online, tree_flatten, tree_random, tree_remap, tree_distance, tree_text_lines, vector_arithmetic, feature_pipeline, ofo_micro, ofo_macro_blocks,
]


def queries():
    return {f.__name__: f for f in _ALL}


def _deep_sql(rest):
    return f"""with recursive {_V}, nw as (select n node_id, i idx, ((n * 7919 + i * 104729) % 1009) / 1009.0::double - 0.5 w from range(511) a(n), range(64) b(i)),
np as (select row_id, node_id, 1 / (1 + exp(-sum(val * w))) p from e join nw using (idx) group by 1, 2) {rest}"""


def _beam_sql(width):
    out = ", b0 as (select row_id, node_id, p from np where node_id = 0)"
    for i in range(1, LEVELS + 1):
        out += f""", k{i} as (select b.row_id, np.node_id, b.p * np.p p from b{i - 1} b join np on np.row_id = b.row_id and np.node_id in (2 * b.node_id + 1, 2 * b.node_id + 2)),
b{i} as (select row_id, node_id, p from (select *, row_number() over (partition by row_id order by p desc, node_id) r from k{i}) where r <= {width})"""
    return _deep_sql(f"{out}, s as (select row_id, node_id - 255 as label, p score from k{LEVELS}) {_topk(3)}")


def _full_sql(rest):
    up = ", a0 as (select i leaf, i node_id from range(255, 511) g(i))" + "".join(f", a{i} as (select leaf, (node_id - 1) // 2 node_id from a{i - 1})" for i in range(1, LEVELS + 1))
    every = " union all ".join(f"select * from a{i}" for i in range(LEVELS + 1))
    return _deep_sql(f"{up}, s as (select row_id, leaf - 255 as label, product(p) score from ({every}) join np using (node_id) group by 1, 2) {rest}")


def _label_tree_sql(rest):
    return f"""with recursive {_P}, kk as (select max(label)::bigint + 1 k from y), tt as (select k, (16 * k - 1 + 14) // 15 t from kk),
po as (select distinct row_id, t - k + label node_id, k, t from y, tt), an(row_id, node_id) as (select row_id, node_id from po union select row_id, (node_id - 1) // 16 from an where node_id > 0),
ng as (select an.row_id, 16 * an.node_id + j node_id from an, range(1, 17) g(j), tt where 16 * an.node_id + j < t except select * from an),
u as (select row_id, node_id::int node_id, 1 y from an union all select row_id, node_id::int, 0 from ng union all select row_id, 0, 0 from r where row_id not in (select row_id from y)) {rest}"""


def oracle_sql():
    same = _reference_sql()
    sizes = """with recursive r as (select row_id, arg_max(struct_pack(l := labels), loaded_at) x from data_points where row_id is not null group by 1), y as (select distinct u as label from (select unnest(x.l) u from r) where u is not null),
        g(n, d) as (select count(*), 1 from y union all select case when j = 0 then (n + 1) // 2 else n // 2 end, d + 1 from g, range(2) h(j) where n > 100)
        select d::int depth, sum(c)::bigint nodes, sum(l)::bigint leaves from (select d, 1 c, 0 l from g union all select d + 1, n, n from g where n <= 100) group by 1"""
    terms = "x as (select row_id, label, score * (0.5 + label % 5) + (label % 7) / 1000.0 score from s where score >= (label % 3) / 200.0)"
    seen = f"with recursive {_P}, u as (select row_id, unnest(x.l) as label, generate_subscripts(x.l, 1) pos from r), m as (select label, min(struct_pack(row_id, pos)) seen from u where label is not null group by 1), o as (select label, row_number() over (order by seen) a from m), k as (select count(*) k from o)"
    return {
        "plt_beam": _beam_sql(3),
        "plt_beam_joins": _beam_sql(3),
        "plt_deep_topk": _full_sql(_topk(3)),
        "plt_parts_topk": _full_sql(_topk(3)),
        "plt_parts_terms": _full_sql(f", {terms} {_topk(3, 'x')}"),
        "hsm_parts_topk": _hsm_sql(_topk(3)),
        "br_blocks_topk": same["br_topk"],
        "ovr_blocks_topk": same["ovr_softmax_topk"],
        "points_nodes_to_update": _label_tree_sql("select * from u"),
        "points_update_stats": _label_tree_sql("select count(*) updates, round(count(*) / (select count(*) from r), 6) updates_per_row from u"),
        "tree_kmeans": sizes,
        "tree_kmeans_labels": f"with {_P} select label, 1::bigint leaves from c",
        "tree_huffman_cost": f"""with recursive {_P}, h(l, s) as (select list_sort(list(cnt / n)), 0.0::double from c, n
            union all select list_sort(list_append(l[3:], l[1] + l[2])), s + l[1] + l[2] from h where len(l) > 1) select round(max(s), 6) cost from h""",
        # the m-th label from the third on splits node m - 2; a label moves to its node's first child
        "tree_online": f"""{seen}, t as (select i from range((select greatest(2 * k - 1, 2) from k)) g(i)), tr(i, x) as (select i, i from t union all select i, (x - 1) // 2 from tr where x % 2 = 1 and x > 1),
            e as (select i, min(x) x from tr where x > 0 group by 1) select t.i::int node_id, (case when t.i = 0 then -1 else (t.i - 1) // 2 end)::int parent_id,
            (case when t.i >= greatest(k - 1, 1) then o.label else -1 end)::int as label from t cross join k left join e on e.i = t.i left join o on o.a = case when e.x % 2 = 1 then 1 else e.x // 2 + 1 end""",
        "tree_flatten": """with recursive t as (select i::int n, (case when i = 0 then -1 else (i - 1) // 3 end)::int p, i >= 40 leaf from range(121) g(i)),
            cl(n, a, d) as (select n, n, 0 from t union all select cl.n, t.p, d + 1 from cl join t on t.n = cl.a where t.p >= 0),
            mv as (select t.n, cl.a p from t join cl on cl.n = t.n and d = 2 where leaf), kp as (select distinct cl.a n from mv join cl on cl.n = mv.p),
            dp as (select kp.n, max(d) + 1 depth, false leaf from kp join cl on cl.n = kp.n group by 1 union all select mv.n, dp.depth + 1, true from mv join (select n, max(d) + 1 depth from cl group by 1) dp on dp.n = mv.p)
            select depth::int depth, count(*) nodes, count(*) filter (leaf) leaves from dp group by 1""",
        "tree_random": """with f as (select ((4 * 1000 - 1 + 2) // 3) - 1000 first), o as (select i::int as label, row_number() over (order by md5(i || ':7'), i) - 1 pos from range(1000) g(i)) select (first + pos)::int node_id, label from o, f""",
        "tree_remap": "select i::int node_id, (case when i = 0 then -1 else (i - 1) // 3 end)::int parent_id, (case when i >= t - 300 then i - (t - 300) else -1 end)::int as label from (select (3 * 300 - 1 + 1) // 2 t), range((select (3 * 300 - 1 + 1) // 2)) g(i)",
        "tree_distance": """with recursive t as (select i n, (i - 1) // 3 p, m moved from range(750) g(i), (values (false), (true)) v(m)), w as (select n, case when n = 0 then -1 when moved and n = 8 then 1 else p end p, moved from t),
            up(s, n, d, moved) as (select n, n, 0, moved from w where n in (700, 333) union all select s, w.p, d + 1, up.moved from up join w on w.n = up.n and w.moved = up.moved where w.p >= 0)
            select a.n::int lca, (a.d + b.d)::int distance, a.moved from up a join up b on a.n = b.n and a.moved = b.moved and a.s = 700 and b.s = 333 qualify row_number() over (partition by a.moved order by a.d + b.d) = 1""",
        "tree_text_lines": "select i::int node_id, (case when i = 0 then -1 else (i - 1) // 5 end)::int parent_id, (case when i >= 50 then i - 50 else -1 end)::int as label from range(250) g(i)",
        "vector_arithmetic": f"""with {_V} select a.row_id, round(sum(a.val) + 0.5 * sum(b.val), 6) axpy, round(sum(case when a.val <> 0 then (1 / a.val) / (1 + abs(1 / a.val)) else 0 end), 6) inverse,
            round(sum(a.val / 10), 6) tenth, round(sum(case when a.idx <> 3 then a.val else 0 end), 6) rest from e a join e b on b.row_id = a.row_id - 1 and a.idx = b.idx group by 1""",
        "feature_pipeline": _pipeline_sql(),
        "ofo_micro": f"""with recursive {_Q}, w as (select run_id, row_id, list(score) s, list(score) filter (hit) hs from k5 join (select run_id, row_id, k5.label, (y.label is not null) hit from k5 left join y using (row_id, label)) z using (run_id, row_id, label)
              where score is not null and not isnan(score) and row_id in (select row_id from r) group by 1, 2),
            o as materialized (select row_number() over (order by row_id, run_id) i, s, coalesce(hs, []) hs, t from w join nt using (row_id)),
            fd(i, a, b) as (select 0::bigint, 10.0::double, 20.0::double union all
              select o.i, a + len(list_filter(hs, lambda v: v >= a / b)), b + len(list_filter(s, lambda v: v >= a / b)) + t from fd join o on o.i = fd.i + 1)
            select round(arg_max(a / b, i), 6) threshold from fd""",
        "ofo_macro_blocks": _macro_sql(),
    }


def _pipeline_sql():
    from .reference import _fnv

    return f"""with {_P}, h as (select row_id, ({_fnv('(idx + 2)::bigint')} % 1000 + 2)::int idx, sum(val) val from f group by 1, 2 having sum(val) <> 0),
        m as (select row_id, idx, val / sqrt(sum(val * val) over (partition by row_id)) val from h)
        select row_id, idx, round(val, 6) val from m where abs(val) > 0.1 union all select row_id, -1, 1.0 from r"""


def _macro_sql():
    base = f"""with {_Q}, l as (select k5.run_id, row_id, k5.label, score, (y.label is not null)::int y, row_id % 4 block from k5 left join y using (row_id, label) where score is not null and not isnan(score)),
        s0 as (select label, 10.0::double a, 20.0::double b from l group by 1)"""
    for i in range(4):
        base += f""", s{i + 1} as (select s.label, s.a + coalesce(sum((score >= s.a / s.b)::int * y), 0) a, s.b + coalesce(sum((score >= s.a / s.b)::int + y), 0) b
            from s{i} s left join l on l.label = s.label and block = {i} group by s.label, s.a, s.b)"""
    return base + " select label, round(a / b, 6) threshold from s4"
