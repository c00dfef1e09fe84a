"""Scoring and search with linear node models.

A model is ``weights(node_id, idx, w)`` and ``models(node_id, class_count,
first_class)``; rows are ``row_id, features``.  A model whose weights and nodes are
few (they are counted first) is broadcast and batches are scored in place, without a
join or shuffle.  A larger one is cut into blocks of bounded size, which meet chunks
of rows in co-grouped Arrow functions: flat models by label blocks with the best
``k`` of each, label trees by parts (subtrees between two depths), where a row only
visits the parts that can still hold one of its best labels.  No plan forms the grid
of rows and nodes.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.losses import sigmoid, squared_hinge_probability
from ..plans.ranking import top_positions
from ..plans.stages import drop_stage, is_empty, write_stage
from .assign import child_positions
from .trees import ancestor_closure

#: Most weights, and most nodes, of a model that is broadcast (12 bytes each); larger models are cut into blocks.
SMALL_MODEL = 4_000_000
#: Weights of one block of a larger model, and feature entries of one chunk of rows that meets it.
BLOCK_WEIGHTS, CHUNK_CELLS = 1_000_000, 4_000_000
CONSTANT_LOGIT = 10.0
SCORES = "row_id bigint, label int, score double"


@contextmanager
def limits(**sizes: int):
    """Other values of SMALL_MODEL, BLOCK_WEIGHTS and CHUNK_CELLS for the plans made inside."""
    before = {k: globals()[k] for k in sizes}
    globals().update(sizes)
    try:
        yield
    finally:
        globals().update(before)


def given_models(nodes: DataFrame) -> DataFrame:
    """Ordinary two-class entries for nodes whose weights are given."""
    return nodes.select("node_id", F.lit(2).alias("class_count"), F.lit(1).alias("first_class"))


def signed_value(raw: Column) -> Column:
    """Raw score with its sign or constant: no class is -10, a single class +-10."""
    const = F.when((F.col("class_count") == 1) & (F.col("first_class") == 1), CONSTANT_LOGIT).otherwise(-CONSTANT_LOGIT)
    return F.when(F.col("class_count") < 2, const).otherwise(F.when(F.col("first_class") == 0, -raw).otherwise(raw))


def probability(value: Column, loss: str = "logistic") -> Column:
    return squared_hinge_probability(value) if loss == "squaredHinge" else sigmoid(value)


def is_small(nodes: DataFrame, weights: DataFrame) -> bool:
    return weights.count() <= SMALL_MODEL and nodes.count() <= SMALL_MODEL


def exploded(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", F.explode("features").alias("f")).select("row_id", F.col("f.idx").alias("idx"), F.col("f.val").alias("val"))


def candidate_values(cand: DataFrame, cells: DataFrame, models: DataFrame, weights: DataFrame) -> DataFrame:
    """``row_id, node_id, *extra`` candidates -> plus ``value``; only those are scored.

    ``cells(row_id, idx, val)`` are the exploded rows, made once by the caller.
    """
    extra = [c for c in cand.columns if c not in ("row_id", "node_id")]
    own = weights.join(cand.select("node_id").distinct(), "node_id", "left_semi")
    dot = cand.select("row_id", "node_id").join(cells, "row_id").join(own, ["node_id", "idx"]).groupBy("row_id", "node_id").agg(F.sum(F.col("val") * F.col("w")).alias("raw"))
    j = cand.join(dot, ["row_id", "node_id"], "left").join(models.select("node_id", "class_count", "first_class"), "node_id")
    return j.select("row_id", "node_id", *extra, signed_value(F.coalesce("raw", F.lit(0.0))).alias("value"))


# flat models --------------------------------------------------------------------------------
def all_values(rows: DataFrame, models: DataFrame, weights: DataFrame) -> DataFrame:
    """``row_id, node_id, value`` of every row at every node (rows x nodes lines by definition)."""
    return flat_scores(rows, models, weights).select("row_id", F.col("label").alias("node_id"), F.col("score").alias("value"))


def _link(v, link: str):
    if link == "logistic":
        return 1 / (1 + np.exp(-np.clip(v, -700, 700)))
    return np.exp(-np.maximum(0, 1 - v) ** 2) if link == "squaredHinge" else v


def _constants(count, first):
    """The value of nodes without two classes, NaN for the others."""
    return np.where(count >= 2, np.nan, np.where((count == 1) & (first == 1), CONSTANT_LOGIT, -CONSTANT_LOGIT))


class _Flat:
    """Nodes in order of id with their weights stored by feature: ``w(node rank, idx, w)`` in any order."""

    def __init__(self, nodes: dict, rank, idx, w):
        self.ids, self.terms = nodes["node_id"], {c: nodes[c] for c in ("lw", "lb", "lt")}
        self.const, self.sign = _constants(nodes["class_count"], nodes["first_class"]), np.where(nodes["first_class"] == 0, -1.0, 1.0)
        o = np.lexsort((rank, idx))
        self.col, self.val = rank[o], w[o]
        self.feats, start = np.unique(idx[o], return_index=True)
        self.start = np.r_[start, len(o)].astype(np.int64)

    def values(self, n, row, i, x):
        """``n`` rows given by entries (row, feature, value) -> an n x nodes array."""
        m = len(self.ids)
        v = np.zeros((n, m))
        if len(self.feats) and len(i):
            at = np.minimum(np.searchsorted(self.feats, i), len(self.feats) - 1)
            ok = self.feats[at] == i
            at, row, x = at[ok], row[ok], x[ok]
            size = self.start[at + 1] - self.start[at]
            pos = np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            v = np.bincount(np.repeat(row, size) * m + self.col[pos], np.repeat(x, size) * self.val[pos], n * m).reshape(n, m)
        return np.where(np.isnan(self.const), v * self.sign, self.const)

    def best(self, rid, width, i, x, k, link, cut, whole):
        """Batches ``row_id, label, score, top, mass``: the best k of each row, all for 0.

        ``cut``: '' or the comparison with the thresholds.  ``whole`` is False for one block
        of a softmax: scores are then exp(value - top) times the weight, and a line without
        label carries the row's ``top`` and ``mass`` (the sum of exponentials).
        """
        end = np.cumsum(width)
        step = max(1, 500_000 // max(len(self.ids), 1))
        for lo in range(0, len(width), step):
            n = len(width[lo : lo + step])
            part = slice(end[lo] - width[lo], end[lo + n - 1])
            v = self.values(n, np.repeat(np.arange(n), width[lo : lo + step]), i[part], x[part])
            own = rid[lo : lo + step]
            top = mass = np.zeros(n)
            if link == "softmax" and v.shape[1]:
                top = v.max(1)
                v = np.exp(v - top[:, None])
                mass = v.sum(1)
                v = v / mass[:, None] if whole else v
            else:
                v = _link(v, link)
            v = v * self.terms["lw"] + self.terms["lb"]
            if cut:
                v = np.where(v > self.terms["lt"] if cut == ">" else v >= self.terms["lt"], v, -np.inf)
            keep = np.argsort(-v, axis=1, kind="stable")[:, :k] if k else np.broadcast_to(np.arange(v.shape[1]), v.shape)
            score = np.take_along_axis(v, keep, 1)
            r, c = np.nonzero(score > -np.inf) if cut else np.indices(score.shape).reshape(2, -1)
            cols = [own[r], self.ids[keep[r, c]].astype(np.int32), score[r, c], top[r], np.zeros(len(r))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["row_id", "label", "score", "top", "mass"])
            if not whole:
                none = pa.nulls(n, pa.int32()), pa.nulls(n, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(own), *none, pa.array(top), pa.array(mass)], names=["row_id", "label", "score", "top", "mass"])


def _revived(kind, state: dict):
    out = kind.__new__(kind)
    out.__dict__.update(state)
    return out


def _lists(col):
    """Widths and members of an Arrow list column."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), col.flatten().to_numpy(zero_copy_only=False)


def _plain(col):
    return col.to_numpy() if isinstance(col, pa.ChunkedArray) else col.to_numpy(zero_copy_only=False)


def _entries(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row_id").cast("long"), F.col("features.idx").alias("i"), F.col("features.val").alias("v"))


def flat_scores(rows: DataFrame, models: DataFrame, weights: DataFrame, k: int = 0, link: str = "none", label_weights: DataFrame | None = None, label_biases: DataFrame | None = None,
                threshold: float = 0.0, label_thresholds: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """``row_id, label (= node), score`` of ``link(value) * weight + bias``, the best ``k`` of a row that pass (0: all).

    ``link``: 'none', 'logistic', 'squaredHinge' or 'softmax'.  Labels without a weight,
    bias or threshold of their own have 1, 0 and the scalar one; a scalar threshold of
    0 or less lets all pass.
    """
    nodes = models.select("node_id", "class_count", "first_class")
    for table, name, own, usual in ((label_weights, "weight", "lw", 1.0), (label_biases, "bias", "lb", 0.0), (label_thresholds, "threshold", "lt", threshold if threshold > 0 or label_thresholds is not None else -np.inf)):
        nodes = nodes.withColumn(own, F.lit(float(usual))) if table is None else nodes.join(table.select(F.col("label").alias("node_id"), F.col(name).cast("double").alias(own)), "node_id", "left").withColumn(own, F.coalesce(own, F.lit(float(usual))))
    cut = (">" if strict else ">=") if threshold > 0 or label_thresholds is not None else ""
    if is_small(models, weights):
        return _broadcast_scores(rows, nodes, weights, k, link, cut)
    if link != "softmax":
        return top_k(_block_scores(rows, nodes, weights, k, link, cut).select("row_id", "label", "score"), k)
    # the sum of all exponentials is only known over all blocks, so thresholds come last
    each = _block_scores(rows, nodes, weights, k if label_thresholds is None else 0, link, "")
    w = Window.partitionBy("row_id")
    each = each.withColumn("all", F.max("top").over(w)).withColumn("z", F.sum(F.col("mass") * F.exp(F.col("top") - F.col("all"))).over(w))
    s = each.filter("label is not null").select("row_id", "label", (F.col("score") * F.exp(F.col("top") - F.col("all")) / F.col("z")).alias("score"))
    return top_k(apply_thresholds(s, threshold, label_thresholds, strict), k)


def _broadcast_scores(rows, nodes, weights, k, link, cut):
    table = nodes.toPandas().sort_values("node_id")
    own = {c: table[c].to_numpy(np.int64 if c in ("node_id", "class_count", "first_class") else float) for c in table.columns}
    w = weights.select("node_id", "idx", "w").toPandas()
    w = w[w["node_id"].isin(own["node_id"])]
    flat = _Flat(own, np.searchsorted(own["node_id"], w["node_id"].to_numpy(np.int64)), w["idx"].to_numpy(np.int64), w["w"].to_numpy(float))
    shared = rows.sparkSession.sparkContext.broadcast(vars(flat))  # plain arrays: executors have no copy of the package

    def score(batches):
        flat = _revived(_Flat, shared.value)
        for b in batches:
            (width, i), (_, x) = _lists(b.column(1)), _lists(b.column(2))
            for out in flat.best(_plain(b.column(0)), width, i, x, k, link, cut, True):
                yield out.select(["row_id", "label", "score"])

    return _entries(rows).mapInArrow(score, SCORES)


def _node_vectors(nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """``nodes`` with their sorted weights as arrays ``wi``, ``ww`` and their number ``size``; a node's vector is one row."""
    vec = weights.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("f"))
    none = F.array().cast("array<struct<idx:int,w:double>>")
    j = nodes.join(vec, "node_id", "left").withColumn("f", F.coalesce("f", none))
    return j.select(*nodes.columns, F.col("f.idx").alias("wi"), F.col("f.w").alias("ww"), F.size("f").cast("long").alias("size"))


def _chunks(entries: DataFrame) -> int:
    n = entries.agg(F.coalesce(F.sum(F.size("i") + F.lit(1)), F.lit(0))).first()[0]
    return max(1, -(-n // CHUNK_CELLS))


def _block_scores(rows, nodes, weights, k, link, cut):
    """A large flat model by blocks: chunks of rows x blocks of nodes, local best k.

    A node's block is a hash, so its weights go there in one shuffle, as they are.
    """
    many = max(1, -(-(weights.count() + nodes.count()) // BLOCK_WEIGHTS))
    entries = write_stage(_entries(rows), "entries")
    c = _chunks(entries)
    left = entries.withColumns({"chunk": F.pmod(F.xxhash64("row_id"), F.lit(c)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(many - 1)))})
    both = nodes.withColumns({"idx": F.lit(None).cast("int"), "w": F.lit(None).cast("double")}).unionByName(weights.select("node_id", "idx", "w"), allowMissingColumns=True)
    right = both.withColumns({"block": F.pmod(F.xxhash64("node_id"), F.lit(many)).cast("int"), "chunk": F.explode(F.sequence(F.lit(0), F.lit(c - 1)))})

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("row_id", pa.int64()), ("label", pa.int32()), ("score", pa.float64()), ("top", pa.float64()), ("mass", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        node = b.filter(b["idx"].is_null()).sort_by("node_id")  # a line without idx is the node itself
        own = {n: _plain(node[n]) for n in ("node_id", "class_count", "first_class", "lw", "lb", "lt")}
        b = b.filter(b["idx"].is_valid()).select(["node_id", "idx", "w"])
        if not node.num_rows:
            return schema.empty_table()
        of, idx, w = _plain(b["node_id"]), _plain(b["idx"]).astype(np.int64), _plain(b["w"])
        rank = np.minimum(np.searchsorted(own["node_id"], of), node.num_rows - 1)
        known = own["node_id"][rank] == of  # weights of nodes that aren't asked for
        flat = _Flat(own, rank[known], idx[known], w[known])
        (width, i), (_, x) = _lists(a["i"]), _lists(a["v"])
        return pa.Table.from_batches(list(flat.best(_plain(a["row_id"]), width, i, x, k, link, cut, link != "softmax")), schema)

    met = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
    return met.applyInArrow(score, SCORES + ", top double, mass double")


def top_k(scores: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The k best ``label`` by ``score`` of each row, ties by label; 0 keeps all."""
    if not k:
        return scores
    w = Window.partitionBy("row_id", *(by or [])).orderBy(F.col("score").desc(), F.col("label"))
    # a row's candidates are at most the labels; row_number <= k is pushed below the shuffle
    return scores.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def apply_label_terms(scores: DataFrame, label_weights: DataFrame | None = None, label_biases: DataFrame | None = None) -> DataFrame:
    """``score * weight + bias``; labels without an entry have weight 1 and bias 0."""
    if label_weights is not None:
        scores = scores.join(label_weights.select("label", F.col("weight").alias("_w")), "label", "left").withColumn("score", F.col("score") * F.coalesce("_w", F.lit(1.0))).drop("_w")
    if label_biases is not None:
        scores = scores.join(label_biases.select("label", F.col("bias").alias("_b")), "label", "left").withColumn("score", F.col("score") + F.coalesce("_b", F.lit(0.0))).drop("_b")
    return scores


def apply_thresholds(scores: DataFrame, threshold: float = 0.0, label_thresholds: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Keep ``score >= t`` (``> t`` if strict); a label without its own threshold keeps the scalar."""
    t = F.lit(float(threshold))
    if label_thresholds is not None:
        scores = scores.join(label_thresholds.select("label", F.col("threshold").alias("_t")), "label", "left")
        t = F.coalesce("_t", t)
    elif threshold <= 0:
        return scores
    kept = scores.filter(F.col("score") > t if strict else F.col("score") >= t)
    return kept.drop("_t")


def br_predict(rows, models, weights, k: int = 5, threshold: float = 0.0, label_thresholds=None, label_weights=None, loss: str = "logistic", label_biases=None) -> DataFrame:
    """One-vs-rest probabilities of every label: weights and biases, thresholds (strict), top k."""
    return flat_scores(rows, models, weights, k, loss if loss == "squaredHinge" else "logistic", label_weights, label_biases, threshold, label_thresholds)


def ovr_predict(rows, models, weights, k: int = 5, label_weights=None, threshold: float = 0.0, label_thresholds=None) -> DataFrame:
    """Softmax over the scores of all labels; thresholds (strict) bound the weighted score."""
    return flat_scores(rows, models, weights, k, "softmax", label_weights, None, threshold, label_thresholds)


# label trees --------------------------------------------------------------------------------
def path_scores(node_prob: DataFrame, tree: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """``row_id, node_id, p`` of every node -> ``row_id, label, score``: the product along each label's path."""
    closure = closure or ancestor_closure(tree)
    paths = tree.filter("label <> -1").select("node_id", "label").join(closure, "node_id").select("label", F.col("ancestor_id").alias("node_id"))
    return node_prob.join(paths, "node_id").groupBy("row_id", "label").agg(F.product("p").alias("score"))


def tree_models(tree: DataFrame, models: DataFrame) -> DataFrame:
    """``node_id, parent_id, label, class_count, first_class``; a node that was never trained has no class."""
    m = tree.select("node_id", "parent_id", "label").join(models.select("node_id", "class_count", "first_class"), "node_id", "left")
    return m.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("class_count", "first_class")})


def plt_scores(rows, tree, models, weights, loss: str = "logistic") -> DataFrame:
    """Probabilities of every label of a probabilistic label tree, by full scoring."""
    v = all_values(rows, tree_models(tree, models), weights).select("row_id", "node_id", probability(F.col("value"), loss).alias("p"))
    return path_scores(v, tree)


def plt_predict(rows, tree, models, weights, k: int = 5, threshold: float = 0.0, label_thresholds=None, label_weights=None, label_biases=None, loss: str = "logistic", closure=None) -> DataFrame:
    """Exact top k of ``prob * weight + bias``.  Scalar thresholds and per-label ones bound the probability (``>=``)."""
    return tree_search(rows, tree, models, weights, k, threshold, loss, "plt", label_thresholds, label_weights, label_biases, closure)


def hsm_predict(rows, tree, models, weights, k: int = 5, loss: str = "logistic", threshold: float = 0.0, label_thresholds=None, label_weights=None, label_biases=None) -> DataFrame:
    """Hierarchical softmax: two children p and 1 - p of the first, more by softmax, an only child 1; the root as a base."""
    return tree_search(rows, tree, models, weights, k, threshold, loss, "hsm", label_thresholds, label_weights, label_biases)


class _Part:
    """Connected nodes of a label tree with their weights, and the way down through them.

    Columns as arrays: node_id, parent_id, label, class_count, first_class, and the
    terms of the labels below: lw (largest weight), lb (largest bias), lt (least
    threshold).  A frontier is (row, node id, probability) of nodes that are scored;
    a step scores their children, so siblings are always scored together.
    """

    def __init__(self, nodes: dict, size, wi, ww, loss: str, rule: str, threshold: float, k: int):
        o = np.lexsort((nodes["node_id"], nodes["parent_id"]))
        self.c = {n: v[o] for n, v in nodes.items()}
        back = np.empty(len(o), np.int64)
        back[o] = np.arange(len(o))
        key = (np.repeat(back, size) << 32) + wi.astype(np.int64) + 1
        at = np.argsort(key, kind="stable")
        self.key, self.w = key[at], ww[at]
        self.up, start = np.unique(self.c["parent_id"], return_index=True)
        self.start = np.r_[start, len(o)].astype(np.int64)
        self.const, self.sign = _constants(self.c["class_count"], self.c["first_class"]), np.where(self.c["first_class"] == 0, -1.0, 1.0)
        self.loss, self.rule, self.threshold, self.k = loss, rule, threshold, k

    def values(self, x, row, node):
        """Values of (row, node position) pairs; ``x`` is (widths' ends, features, values)."""
        end, i, v = x
        first = np.r_[0, end]
        out = np.zeros(len(row))
        size = first[row + 1] - first[row]
        cum = np.cumsum(size)
        lo = 0
        while lo < len(row) and len(self.key):
            hi = max(lo + 1, int(np.searchsorted(cum, (cum[lo - 1] if lo else 0) + CHUNK_CELLS, "right")))
            s = size[lo:hi]
            pos = np.repeat(first[row[lo:hi]] - (np.cumsum(s) - s), s) + np.arange(s.sum())
            want = (np.repeat(node[lo:hi], s) << 32) + i[pos] + 1
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            out[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), s), np.where(self.key[at] == want, self.w[at] * v[pos], 0.0), hi - lo)
            lo = hi
        return np.where(np.isnan(self.const[node]), out * self.sign[node], self.const[node])

    def step(self, x, row, node, p):
        """Children of the frontier: ``(row, position, probability)``."""
        slot = np.searchsorted(self.up, node)
        many = self.start[slot + 1] - self.start[slot]
        group = np.repeat(np.arange(len(row)), many)
        begin = np.cumsum(many) - many
        kid = np.arange(many.sum()) - np.repeat(begin - self.start[slot], many)
        r = row[group]
        v = self.values(x, r, kid)
        q = _link(v, "squaredHinge" if self.loss == "squaredHinge" else "logistic")
        if self.rule == "hsm" and len(v):
            among = many[group]
            top = np.maximum.reduceat(v, begin)[group]
            e = np.exp(v - top)
            soft = e / np.add.reduceat(e, begin)[group]
            lead = q[begin][group]
            pair = np.where(np.arange(len(v)) == begin[group], lead, 1 - lead)
            q = np.where(self.c["parent_id"][kid] < 0, q, np.where(among == 1, 1.0, np.where(among == 2, pair, soft)))
        return r, kid, p[group] * q

    def upper(self, kid, p):
        """The most that a label at or below can score; exact for leaves."""
        w = p * self.c["lw"][kid]
        return np.where(self.c["label"][kid] >= 0, w, np.maximum(w, 0.0)) + self.c["lb"][kid]

    def down(self, x, row, node, p, width=0, bound=None):
        """``(leaves, exits, scored)``: leaves and exits are (row, position, probability).

        ``width`` keeps a row's best inner nodes of each level; ``bound`` drops what
        can't reach a row's score; exits are inner nodes whose children lie elsewhere.
        """
        leaves, exits, scored = [], [], []
        known = np.isin(node, self.up)
        row, node, p = row[known], node[known], p[known]
        while len(row):
            r, kid, p = self.step(x, row, node, p)
            scored.append(r)
            ok = p >= self.c["lt"][kid]
            if bound is not None:
                ok &= self.upper(kid, p) >= bound[r]
            r, kid, p = r[ok], kid[ok], p[ok]
            leaf = self.c["label"][kid] >= 0
            leaves.append((r[leaf], kid[leaf], p[leaf]))
            r, kid, p = r[~leaf], kid[~leaf], p[~leaf]
            if width:
                keep = first_of_each(r, -self.upper(kid, p), self.c["node_id"][kid], width)
                r, kid, p = r[keep], kid[keep], p[keep]
            inside = np.isin(self.c["node_id"][kid], self.up)
            exits.append((r[~inside], kid[~inside], p[~inside]))
            row, node, p = r[inside], self.c["node_id"][kid[inside]], p[inside]
        join = lambda parts: tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return join(leaves), join(exits), np.concatenate(scored) if scored else np.zeros(0, np.int64)

    def score(self, kid, p):
        return p * self.c["lw"][kid] + self.c["lb"][kid]

    def kth(self, n, r, score):
        """Each row's k-th best score, minus infinity for rows with fewer; a hair less for rounding."""
        out = np.full(n, -np.inf)
        if self.k and len(r):
            o = np.lexsort((-score, r))
            r, score = r[o], score[o]
            begin = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            at = begin + self.k - 1
            ok = at < np.r_[begin[1:], len(r)]
            out[r[begin[ok]]] = score[at[ok]] - 1e-12 * np.abs(score[at[ok]])
        return out


def first_of_each(group, rank, tie, k: int):
    """Positions of the k first of each group by (rank, tie)."""
    o = np.lexsort((tie, rank, group))
    g = group[o]
    begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, len(g)])
    return o[np.arange(len(g)) - np.repeat(begin, size) < k]


def label_bounds(tree: DataFrame, threshold: float = 0.0, label_thresholds=None, label_weights=None, label_biases=None, closure=None) -> DataFrame | None:
    """``node_id, lw, lb, lt``: the largest weight and bias and the least threshold of the labels below; None if none is given."""
    out = None
    for table, name, own, usual, how in ((label_weights, "weight", "lw", 1.0, "max"), (label_biases, "bias", "lb", 0.0, "max"), (label_thresholds, "threshold", "lt", threshold, "min")):
        if table is None:
            continue
        closure = closure if closure is not None else write_stage(ancestor_closure(tree), "closure")
        full = tree.filter("label <> -1").select("label").join(table.select("label", F.col(name).cast("double").alias("v")), "label", "left").select("label", F.coalesce("v", F.lit(float(usual))).alias("v"))
        b = node_bounds(tree, full, "v", how, closure).select("node_id", F.col("bound").alias(own))
        out = b if out is None else out.join(b, "node_id")
    return out


_COLUMNS = ("node_id", "parent_id", "label", "class_count", "first_class", "lw", "lb", "lt")


def _tree_nodes(tree, models, threshold, label_thresholds, label_weights, label_biases, closure=None):
    nodes = tree_models(tree, models)
    bounds = label_bounds(tree, threshold, label_thresholds, label_weights, label_biases, closure)
    usual = {"lw": 1.0, "lb": 0.0, "lt": float(threshold)}
    if bounds is not None:
        nodes = nodes.join(bounds, "node_id", "left")
    return nodes.withColumns({c: F.coalesce(c, F.lit(v)) if bounds is not None and c in bounds.columns else F.lit(v) for c, v in usual.items()})


def _part_of(get, size, wi, ww, *how) -> _Part:
    cols = {c: np.asarray(get(c)).astype(float if c in ("lw", "lb", "lt") else np.int64) for c in _COLUMNS}
    return _Part(cols, size, wi, ww, *how)


def tree_search(rows, tree, models, weights, k: int = 5, threshold: float = 0.0, loss: str = "logistic", rule: str = "plt", label_thresholds=None, label_weights=None, label_biases=None, closure=None, width: int = 0, count: bool = False) -> DataFrame:
    """``row_id, label, score``: the exact best ``k`` labels of a tree (0: all), or those of a beam of ``width``.

    Scores are ``prob * weight + bias``; labels whose probability is below their
    threshold are left out.  First a beam of width k finds k labels; their worst score
    then bounds an exact way down, level by level for many rows at once: subtrees that
    can't reach it (by the bounds of their labels' terms) are never scored.  Ties go
    by label.  ``count`` gives ``row_id, evaluated`` instead: node estimators scored.
    """
    nodes = _tree_nodes(tree, models, threshold, label_thresholds, label_weights, label_biases, closure)
    how = (loss, rule, threshold, k)
    if not is_small(tree, weights):
        if count or width:
            raise ValueError("beams and counts of estimators of large models go level by level: see plt_beam")
        return _search_parts(rows, nodes, weights, how)
    table = nodes.select(*_COLUMNS).toPandas()
    w = weights.select("node_id", "idx", "w").toPandas()
    ids = np.sort(table["node_id"].to_numpy(np.int64))
    w = w[w["node_id"].isin(ids)].sort_values("node_id")
    table = table.sort_values("node_id")
    size = np.diff(np.searchsorted(w["node_id"].to_numpy(np.int64), np.r_[ids, np.iinfo(np.int64).max]))
    part = _part_of(lambda c: table[c].to_numpy(), size, w["idx"].to_numpy(np.int64), w["w"].to_numpy(float), *how)
    shared = rows.sparkSession.sparkContext.broadcast(vars(part))

    def search(batches):
        m = _revived(_Part, shared.value)
        for b in batches:
            rid = _plain(b.column(0))
            (wide, i), (_, v) = _lists(b.column(1)), _lists(b.column(2))
            n = len(rid)
            x = (np.cumsum(wide), i.astype(np.int64), v)
            start = np.arange(n), np.full(n, -1, np.int64), np.ones(n)
            seen, bound = [], None
            if width:
                (r, kid, p), _, s = m.down(x, *start, width=width)
                seen.append(s)
            else:
                if m.k:
                    (r, kid, p), _, s = m.down(x, *start, width=m.k)
                    bound = m.kth(n, r, m.score(kid, p))
                    seen.append(s)
                (r, kid, p), _, s = m.down(x, *start, bound=bound)
                seen.append(s)
            if count:
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(np.bincount(np.concatenate(seen), minlength=n).astype(np.int64))], names=["row_id", "evaluated"])
                continue
            score, lab = m.score(kid, p), m.c["label"][kid]
            if m.k:
                keep = first_of_each(r, -score, lab, m.k)
                r, score, lab = r[keep], score[keep], lab[keep]
            yield pa.RecordBatch.from_arrays([pa.array(rid[r]), pa.array(lab.astype(np.int32)), pa.array(score)], names=["row_id", "label", "score"])

    return _entries(rows).mapInArrow(search, "row_id bigint, evaluated bigint" if count else SCORES)


def _cuts(nodes: DataFrame, vec: DataFrame) -> DataFrame:
    """``node_id, tier, part``: where a large tree is cut.

    A part is a node's descendants down to the next cut; a tier is cut as deep as its
    largest part stays within ``BLOCK_WEIGHTS`` (at least one level).  ``part`` is the
    node above, -1 for the tier that holds the root.
    """
    tree = nodes.select("node_id", "parent_id")
    closure = write_stage(ancestor_closure(tree), "closure")
    depth = closure.groupBy("node_id").agg(F.max("distance").alias("depth"))
    size = write_stage(vec.select("node_id", (F.col("size") + 1).alias("size")).join(depth, "node_id"), "depths")
    deepest = size.agg(F.max("depth")).first()[0]
    out, above = None, -1  # the depth of the nodes that hold the parts of this tier
    while deepest is not None and above < deepest:
        if above < 0:
            below = size.select("node_id", "size", F.lit(-1).alias("part"), "depth")
        else:
            on = closure.join(size.filter(F.col("depth") == above).select(F.col("node_id").alias("ancestor_id")), "ancestor_id").filter("distance > 0")
            below = on.select("node_id", F.col("ancestor_id").alias("part")).join(size, "node_id")
        w = Window.partitionBy("part").orderBy("depth")  # levels of one part
        cum = below.groupBy("part", "depth").agg(F.sum("size").alias("s")).withColumn("s", F.sum("s").over(w)).groupBy("depth").agg(F.max("s").alias("s"))
        fit = [r["depth"] for r in cum.collect() if r["s"] <= BLOCK_WEIGHTS]  # a row per level
        last = max([above + 1, *fit])
        tier = below.filter(F.col("depth") <= last).select("node_id", F.lit(0 if out is None else out[1]).alias("tier"), "part")
        out = (tier, 1) if out is None else (out[0].unionByName(tier), out[1] + 1)
        above = last
    return out


def _search_parts(rows, nodes, weights, how) -> DataFrame:
    """The search of ``tree_search`` over a tree cut into parts; entries carry rows from tier to tier."""
    loss, rule, threshold, k = how
    nodes = write_stage(nodes, "nodes")
    vec = write_stage(_node_vectors(nodes, weights), "nodevectors")
    cuts, tiers = _cuts(nodes, vec)
    parts = write_stage(vec.join(cuts, "node_id"), "parts")
    entries = write_stage(_entries(rows), "entries")
    cells = entries.agg(F.coalesce(F.avg(F.size("i") + F.lit(1)), F.lit(1.0))).first()[0]
    start = entries.select("row_id", F.lit(-1).cast("long").alias("node"), F.lit(1.0).alias("p"))

    def descend(width, bound):
        """All tiers from the root: ``row_id, label, score`` of the leaves met."""
        front, leaves = start, None
        for t in range(tiers):
            if bound is not None:
                front = front.join(bound, "row_id", "left")
            met = write_stage(_visit(front, entries, parts.filter(F.col("tier") == t), cells, how, width), "tier")
            got = met.filter("label >= 0").select("row_id", F.col("label").cast("int"), "score")
            leaves = got if leaves is None else leaves.unionByName(got)
            front = met.filter("label < 0").select("row_id", "node", "p", "score")
            if width:
                w = Window.partitionBy("row_id").orderBy(F.col("score").desc(), "node")
                front = front.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= width)
            front = front.select("row_id", "node", "p")
            if is_empty(front):
                break
        return top_k(leaves, k)

    if not k:
        return descend(0, None)
    some = descend(k, None)
    w = F.min("score") - 1e-12 * F.abs(F.min("score"))
    bound = write_stage(some.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), w.alias("bound")).filter(F.col("n") >= k).select("row_id", "bound"), "bounds")
    return descend(0, bound)


def _visit(front, entries, parts, cells, how, width) -> DataFrame:
    """One tier: ``front(row_id, node, p[, bound])`` meets the parts below its nodes.

    A part that many rows enter is met by as many chunks of them as their entries need.
    """
    if "bound" not in front.columns:
        front = front.withColumn("bound", F.lit(None).cast("double"))
    per = max(1, int(CHUNK_CELLS / max(cells, 1)))
    # small parts share a task: their block number is a hash, as many blocks as their weights fill
    total = parts.agg(F.coalesce(F.sum(F.col("size") + 1), F.lit(0)).alias("s")).first()[0]
    blocks = max(1, -(-total // BLOCK_WEIGHTS))
    block = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(blocks)).cast("int")
    placed = front.withColumn("block", block("node"))
    many = placed.groupBy("block").agg((F.floor(F.count(F.lit(1)) / per) + 1).cast("int").alias("chunks"))
    many = write_stage(many, "chunks")
    own = placed.groupBy("row_id", "block").agg(F.max("bound").alias("bound"), F.collect_list("node").alias("node"), F.collect_list("p").alias("p"))
    left = own.join(entries, "row_id").join(many, "block").withColumn("chunk", F.pmod(F.xxhash64("row_id"), F.col("chunks")).cast("int")).drop("chunks")
    right = parts.withColumn("block", block("part")).join(many, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def go(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("row_id", pa.int64()), ("label", pa.int64()), ("node", pa.int64()), ("p", pa.float64()), ("score", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        (size, wi), (_, ww) = _lists(b["wi"]), _lists(b["ww"])
        m = _part_of(lambda c: _plain(b[c]), size, wi, ww, *how)
        rid = _plain(a["row_id"])
        (wide, i), (_, v) = _lists(a["i"]), _lists(a["v"])
        (each, node), (_, p) = _lists(a["node"]), _lists(a["p"])
        bound = np.nan_to_num(a["bound"].cast(pa.float64()).to_numpy().astype(float), nan=-np.inf)
        start = np.repeat(np.arange(len(rid)), each), node.astype(np.int64), p
        (r, kid, q), (er, ekid, eq), _ = m.down((np.cumsum(wide), i.astype(np.int64), v), *start, width=width, bound=bound)
        s = m.score(kid, q)
        if m.k:  # of one visit only the best can be among the best of all
            keep = first_of_each(r, -s, m.c["label"][kid], m.k)
            r, kid, q, s = r[keep], kid[keep], q[keep], s[keep]
        cols = [
            np.r_[rid[r], rid[er]], np.r_[m.c["label"][kid], np.full(len(er), -1)], np.r_[m.c["node_id"][kid], m.c["node_id"][ekid]], np.r_[q, eq], np.r_[s, m.upper(ekid, eq)],
        ]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    met = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
    return met.applyInArrow(go, "row_id bigint, label bigint, node bigint, p double, score double")


def plt_beam(rows, tree, models, weights, k: int = 5, width: int = 10, threshold: float = 0.0, loss: str = "logistic", label_thresholds=None, label_weights=None, label_biases=None) -> DataFrame:
    """Level by level: score the children of each row's frontier, keep the best ``width`` inner nodes.

    Label weights, biases and thresholds rank and cut by the bounds of the labels below
    a node, as in the exact search.  A small model is searched batch by batch; a large
    one level by level over joins, the cut being a window over a row's few nodes.
    """
    if is_small(tree, weights):
        return tree_search(rows, tree, models, weights, k, threshold, loss, "plt", label_thresholds, label_weights, label_biases, width=width)
    nodes = write_stage(_tree_nodes(tree, models, threshold, label_thresholds, label_weights, label_biases), "nodes")
    root = nodes.filter("parent_id = -1").select("node_id").first()["node_id"]
    terms = nodes.select("node_id", F.col("label").alias("leaf"), "lw", "lb", "lt")
    kids = nodes.filter("parent_id <> -1").select(F.col("parent_id").alias("up"), "node_id")
    cells = write_stage(exploded(rows), "cells")
    cand = rows.select("row_id", F.lit(root).alias("node_id"), F.lit(1.0).alias("above"))
    done = None
    while True:
        v = candidate_values(cand, cells, nodes, weights).select("row_id", "node_id", (F.col("above") * probability(F.col("value"), loss)).alias("p"))
        w = F.col("p") * F.col("lw")
        rank = F.when(F.col("leaf") >= 0, w).otherwise(F.greatest(w, F.lit(0.0))) + F.col("lb")
        level = write_stage(v.join(terms, "node_id").filter("p >= lt").withColumn("rank", rank), "beam")
        leaves = level.filter("leaf <> -1").select("row_id", F.col("leaf").alias("label"), F.col("rank").alias("score"))
        done = leaves if done is None else done.unionByName(leaves)
        w = Window.partitionBy("row_id").orderBy(F.col("rank").desc(), "node_id")
        front = level.filter("leaf = -1").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= width)
        if is_empty(front):
            drop_stage(cells)
            return top_k(done, k)
        cand = front.select("row_id", F.col("node_id").alias("up"), F.col("p").alias("above")).join(kids, "up").select("row_id", "node_id", "above")


def node_bounds(tree: DataFrame, per_label: DataFrame, value: str, how: str, closure: DataFrame | None = None) -> DataFrame:
    """``node_id, bound, label`` of a label vector over the leaves below: 'max' or 'min', with the label that has it."""
    closure = closure if closure is not None else ancestor_closure(tree)
    v = tree.filter("label <> -1").select("node_id", "label").join(per_label.select("label", F.col(value).alias("v")), "label").join(closure, "node_id")
    pick = F.max(F.struct("v", (-F.col("label")).alias("l"))) if how == "max" else F.min(F.struct("v", F.col("label").alias("l")))
    return v.groupBy(F.col("ancestor_id").alias("node_id")).agg(pick.alias("b")).select("node_id", F.col("b.v").alias("bound"), F.abs("b.l").alias("label"))


def evaluated_nodes(rows, tree, models, weights, k: int = 5, threshold: float = 0.0, loss: str = "logistic", rule: str = "plt", width: int = 0) -> DataFrame:
    """``row_id, evaluated``: node estimators that the search of each row scores (small models)."""
    return tree_search(rows, tree, models, weights, k, threshold, loss, rule, width=width, count=True)


def predict_for_label(rows, pairs: DataFrame, tree, models, weights, loss: str = "logistic") -> DataFrame:
    """``row_id, label, score`` of given (row, label) pairs; a label that is not in the tree has 0."""
    paths = tree.filter("label <> -1").select("node_id", "label").join(ancestor_closure(tree), "node_id").select("label", F.col("ancestor_id").alias("node_id"))
    cand = pairs.select("row_id", "label").join(paths, "label")
    v = candidate_values(cand.select("row_id", "node_id").distinct(), exploded(rows), tree_models(tree, models), weights).select("row_id", "node_id", probability(F.col("value"), loss).alias("p"))
    s = cand.join(v, ["row_id", "node_id"]).groupBy("row_id", "label").agg(F.product("p").alias("score"))
    return pairs.select("row_id", "label").join(s, ["row_id", "label"], "left").select("row_id", "label", F.coalesce("score", F.lit(0.0)).alias("score"))


def hsm_predict_for_label(rows, pairs: DataFrame, tree, models, weights, loss: str = "logistic") -> DataFrame:
    """As ``predict_for_label`` for hierarchical softmax: the siblings along the labels' paths are scored too."""
    paths = tree.filter("label <> -1").select("node_id", "label").join(ancestor_closure(tree), "node_id").select("label", F.col("ancestor_id").alias("node_id"))
    on = pairs.select("row_id", "label").join(paths, "label")
    pos = child_positions(tree)
    need = on.select("row_id", "node_id").join(pos, "node_id", "left").select("row_id", "node_id", "parent_id").distinct()
    sib = need.filter("parent_id is not null").select("row_id", "parent_id").distinct().join(pos, "parent_id").select("row_id", "node_id")
    cand = sib.unionByName(need.filter("parent_id is null").select("row_id", "node_id"))
    v = candidate_values(cand, exploded(rows), tree_models(tree, models), weights).join(pos, "node_id", "left")
    among = Window.partitionBy("row_id", "parent_id")
    lead = F.max(F.when(F.col("child_pos") == 0, probability(F.col("value"), loss))).over(among)
    e = F.exp(F.col("value") - F.max("value").over(among))
    p = (
        F.when(F.col("parent_id").isNull(), probability(F.col("value"), loss)).when(F.col("n_children") == 1, 1.0)
        .when(F.col("n_children") == 2, F.when(F.col("child_pos") == 0, lead).otherwise(1 - lead)).otherwise(e / F.sum(e).over(among))
    )
    s = on.join(v.select("row_id", "node_id", p.alias("p")), ["row_id", "node_id"]).groupBy("row_id", "label").agg(F.product("p").alias("score"))
    return pairs.select("row_id", "label").join(s, ["row_id", "label"], "left").select("row_id", "label", F.coalesce("score", F.lit(0.0)).alias("score"))


def mach_predict(bucket_prob: DataFrame, label_buckets: DataFrame, k: int = 5, label_weights=None, threshold: float = 0.0, label_thresholds=None) -> DataFrame:
    """``row_id, hash_no, bucket, p`` and ``label, hash_no, bucket`` -> 1 + the sum of bucket probabilities.

    A label is a flat node with weight 1 at its buckets, so the labels are scored by
    blocks, and only the best of each block leave it.  Thresholds bound the weighted score (``>=``).
    """
    width = label_buckets.agg(F.coalesce(F.max("bucket"), F.lit(0))).first()[0] + 1
    slot = lambda h, b: (F.col(h) * width + F.col(b)).cast("int")
    rows = bucket_prob.groupBy("row_id").agg(F.collect_list(F.struct(slot("hash_no", "bucket").alias("idx"), F.col("p").alias("val"))).alias("features"))
    nodes = given_models(label_buckets.select(F.col("label").cast("int").alias("node_id")).distinct())
    weights = label_buckets.select(F.col("label").cast("int").alias("node_id"), slot("hash_no", "bucket").alias("idx"), F.lit(1.0).alias("w"))
    # (1 + sum) * weight: a label's weight is its bias as well
    bias = nodes.select(F.col("node_id").alias("label"))
    bias = bias.withColumn("bias", F.lit(1.0)) if label_weights is None else bias.join(label_weights.select("label", F.col("weight").alias("bias")), "label", "left").withColumn("bias", F.coalesce("bias", F.lit(1.0)))
    return flat_scores(rows, nodes, weights, k, "none", label_weights, bias, threshold, label_thresholds, strict=False)


def mach_predict_for_label(bucket_prob: DataFrame, label_buckets: DataFrame, label: int) -> DataFrame:
    own = label_buckets.filter(F.col("label") == label)
    return bucket_prob.join(own, ["hash_no", "bucket"]).groupBy("row_id", "label").agg(F.product("p").alias("score"))


def ensemble_mean(scores: DataFrame, members: int, k: int = 5) -> DataFrame:
    """``member, row_id, label, score``: the sum over members divided by their number; a missing score is 0."""
    return top_k(scores.groupBy("row_id", "label").agg((F.sum("score") / members).alias("score")), k)


def ensemble_filled(scores: DataFrame, point_scores: DataFrame, members: int, k: int = 5) -> DataFrame:
    """As ``ensemble_mean`` with missing scores taken from ``point_scores(member, row_id, label, score)``."""
    cand = scores.select("row_id", "label").distinct()
    own = scores.select("member", "row_id", "label", "score")
    fill = point_scores.join(cand, ["row_id", "label"], "left_semi").join(own.select("member", "row_id", "label"), ["member", "row_id", "label"], "left_anti")
    return ensemble_mean(own.unionByName(fill.select("member", "row_id", "label", "score")), members, k)


def best_groups(scores: DataFrame, k: int) -> DataFrame:
    """Top k for groups that may each hold millions of labels: a global sort instead of a window."""
    return top_positions(scores, ["row_id"], [F.col("score").desc(), F.col("label").asc()], k)
