"""Estimators: PLT, HSM, BR, OVR, MACH, OPLT and XT with fit, predict and persistence.

``x`` and ``y`` are DataFrames (``row_id, features`` / ``row_id, labels``) or anything
the adapters take.  Everything stays a DataFrame until the caller collects.
"""

from __future__ import annotations

import json
from dataclasses import asdict, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import features as fx
from .operators import assign, predict
from .operators import trees as tr
from .operators.extreme_text import hidden_vectors, train_embedding_tree
from .operators.train import TrainOptions, train_one_vs_rest, train_problems, train_siblings
from .plans.stages import drop_stage, write_stage
from .sources.adapters import features_frame, labels_frame
from .sources.files import read_libsvm


class Model:
    kind = ""

    def __init__(self, spark: SparkSession, *, bias: float = 1.0, norm: bool = True, hash: int = 0, features_threshold: float = 0.0, ensemble: int = 0, ens_missing_scores: bool = True, **params):
        self.spark = spark
        self.prep = {"bias": bias, "norm": norm, "hash_size": hash, "threshold": features_threshold}
        self.ensemble = ensemble
        self.ens_missing_scores = ens_missing_scores
        own = {f.name for f in fields(TrainOptions)}
        self.options = TrainOptions(**{k: v for k, v in params.items() if k in own})
        if self.options.loss == "squaredHinge" and "solver" not in params:
            self.options = replace(self.options, solver="L2R_L2LOSS_SVC_DUAL")
        self.extra = {k: v for k, v in params.items() if k not in own}
        self._check_extra()
        self.tree = None
        self.inv_ps = None
        self.thresholds: DataFrame | None = None
        self.members: list[tuple] = []  # (tree, models, weights)

    def _check_extra(self):
        if self.extra:
            raise TypeError(f"unknown parameters: {sorted(self.extra)}")

    def get_params(self) -> dict:
        return {**self.prep, "ensemble": self.ensemble, "ens_missing_scores": self.ens_missing_scores, **asdict(self.options), **self.extra}

    def set_params(self, **params) -> Model:
        self.options = replace(self.options, **{k: v for k, v in params.items() if hasattr(self.options, k)})
        self.ens_missing_scores = params.get("ens_missing_scores", self.ens_missing_scores)
        for k, v in params.items():
            if k in self.prep:
                self.prep[k] = v
            elif k in self.extra:
                self.extra[k] = v
        return self

    def _rows(self, x) -> DataFrame:
        d = features_frame(self.spark, x)
        return d.select("row_id", fx.prepare(F.col("features"), self.prep["bias"], self.prep["norm"], self.prep["hash_size"], self.prep["threshold"]).alias("features"))

    def fit(self, x, y, inv_ps: DataFrame | None = None) -> Model:
        """Train from scratch; a tree set before is kept, a built one is built anew.

        ``inv_ps(label, inv_ps)`` are the inverse propensities for the losses that use them.
        """
        data = write_stage(labels_frame(self.spark, y).join(self._rows(x), "row_id"), "train")
        self.inv_ps = inv_ps
        self.members = [self._fit_member(data, replace(self.options, seed=self.options.seed + i)) for i in range(max(1, self.ensemble))]
        drop_stage(data)
        return self

    def set_thresholds(self, thresholds: DataFrame | None) -> Model:
        """``label, threshold`` used by every prediction that names no threshold; None removes them."""
        self.thresholds = thresholds
        return self

    def fit_on_file(self, path: str) -> Model:
        d = read_libsvm(self.spark, path, raw=True)
        return self.fit(d, d)

    def predict_proba(self, x, top_k: int = 5, threshold=0.0, labels_weights: DataFrame | None = None, labels_biases: DataFrame | None = None) -> DataFrame:
        """``row_id, label, score``, best first by score, ties by label.

        ``threshold`` is a number or ``label, threshold``; it, ``labels_weights(label,
        weight)`` and ``labels_biases(label, bias)`` hold for this call only.

        Each member of an ensemble gives its own best labels.  The members that lack a
        label another one gives score it as well, whatever its threshold; without
        ``ens_missing_scores`` it counts 0 for them.
        """
        if not self.members:
            raise RuntimeError("the model is not fitted or loaded")
        rows = write_stage(self._rows(x), "rows")
        if self.thresholds is not None and threshold == 0.0:
            threshold = self.thresholds
        terms = (labels_weights, labels_biases)
        k = 0 if (not isinstance(threshold, (int, float)) or threshold > 0) and top_k == 5 else top_k
        if len(self.members) == 1:
            return self._predict_member(rows, self.members[0], k, threshold, terms)
        scores = None
        for i, m in enumerate(self.members):
            s = self._predict_member(rows, m, k, threshold, terms).withColumn("member", F.lit(i))
            scores = s if scores is None else scores.unionByName(s)
        if not self.ens_missing_scores:
            return predict.ensemble_mean(scores, len(self.members), k)
        scores = write_stage(scores, "members")
        cand = scores.select("row_id", "label").distinct()
        points = None
        for i, m in enumerate(self.members):
            lacking = cand.join(scores.filter(F.col("member") == i).select("row_id", "label"), ["row_id", "label"], "left_anti")
            s = self._score_pairs(rows, m, lacking, terms).withColumn("member", F.lit(i))
            points = s if points is None else points.unionByName(s)
        return predict.ensemble_filled(scores, points, len(self.members), k)

    def _score_pairs(self, rows, member, pairs, terms) -> DataFrame:
        """Scores of given (row, label) pairs, from scoring all labels."""
        return self._predict_member(rows, member, 0, 0.0, terms).join(pairs, ["row_id", "label"], "left_semi")

    def predict(self, x, **kw) -> DataFrame:
        """``row_id, labels`` in rank order."""
        from .operators.metrics import from_scores

        return from_scores(self.predict_proba(x, **kw))

    def predict_proba_for_file(self, path: str, **kw) -> DataFrame:
        return self.predict_proba(read_libsvm(self.spark, path, raw=True), **kw)

    def predict_for_file(self, path: str, **kw) -> DataFrame:
        return self.predict(read_libsvm(self.spark, path, raw=True), **kw)

    def save(self, path: str) -> None:
        """Parquet tables, one sub-folder a member, and the parameters as JSON."""
        for i, (tree, models, weights) in enumerate(self.members):
            if tree is not None:
                tree.write.mode("overwrite").parquet(f"{path}/member_{i}/tree")
            models.write.mode("overwrite").parquet(f"{path}/member_{i}/models")
            weights.repartition("node_id").sortWithinPartitions("node_id", "idx").write.mode("overwrite").parquet(f"{path}/member_{i}/weights")
        text = json.dumps({"kind": self.kind, "prep": self.prep, "ensemble": self.ensemble, "ens_missing_scores": self.ens_missing_scores, "options": asdict(self.options), "extra": self.extra, "members": len(self.members), "tree": self.members[0][0] is not None})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        c = json.loads(spark.read.text(f"{path}/config").first()[0])
        p = c["prep"]
        m = {k.kind: k for k in (PLT, HSM, BR, OVR, MACH, OPLT, XT)}[c["kind"]](spark, bias=p["bias"], norm=p["norm"], hash=p["hash_size"], features_threshold=p["threshold"], ensemble=c["ensemble"], ens_missing_scores=c.get("ens_missing_scores", True), **c["options"], **c["extra"])
        read = lambda i, t: spark.read.parquet(f"{path}/member_{i}/{t}")
        m.members = [(read(i, "tree") if c["tree"] else None, read(i, "models"), read(i, "weights")) for i in range(c["members"])]
        m.tree = m.members[0][0]
        return OPLT.load_state(m, path) if isinstance(m, OPLT) else m

    @staticmethod
    def preload_tree(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.parquet(f"{path}/member_0/tree")

    def unload(self) -> None:
        self.members = []


class _TreeModel(Model):
    def __init__(self, spark, *, tree_type: str = "hierarchicalKmeans", arity: int = 2, max_leaves: int = 100, flatten_tree: int = 0, kmeans_eps: float = 1e-4, kmeans_balanced: bool = True, kmeans_weighted_features: bool = False, **kw):
        self.tree_args = {"kind": tree_type, "arity": arity, "max_leaves": max_leaves, "flatten": flatten_tree, "eps": kmeans_eps, "balanced": kmeans_balanced, "weighted": kmeans_weighted_features}
        self.given = None
        super().__init__(spark, **kw)
        self.extra.update(tree_type=tree_type, arity=arity, max_leaves=max_leaves, flatten_tree=flatten_tree, kmeans_eps=kmeans_eps, kmeans_balanced=kmeans_balanced, kmeans_weighted_features=kmeans_weighted_features)

    def _check_extra(self):
        unknown = set(self.extra) - {"tree_search_type", "beam_search_width", "pick_one_label_weighting"}
        if unknown:
            raise TypeError(f"unknown parameters: {sorted(unknown)}")

    def build_tree(self, x, y) -> DataFrame:
        data = labels_frame(self.spark, y).join(self._rows(x), "row_id")
        return self._build(data, self.options.seed)

    def _build(self, data: DataFrame, seed: int) -> DataFrame:
        a = self.tree_args
        plain = data.withColumn("features", F.filter("features", lambda f: f["idx"] != fx.BIAS))
        return write_stage(tr.build_tree(self.spark, a["kind"], plain, a["arity"], a["max_leaves"], a["flatten"], seed, a["balanced"], a["eps"], a["weighted"]), "tree")

    def get_tree_structure(self) -> DataFrame:
        t = self.given if self.given is not None else self.tree
        return t.select("parent_id", "node_id", "label")

    def set_tree_structure(self, triples) -> None:
        """(parent, node, label) triples or a DataFrame of them; checked."""
        t = triples if isinstance(triples, DataFrame) else self.spark.createDataFrame([(int(n), int(p), int(-1 if lab is None else lab)) for p, n, lab in triples], tr.TREE)
        t = t.select("node_id", "parent_id", "label")
        tr.check_tree(t)
        self.given = self.tree = write_stage(t, "tree")

    def get_nodes_to_update(self, y) -> DataFrame:
        return assign.nodes_to_update(labels_frame(self.spark, y), self.tree)

    def get_nodes_updates(self, y) -> DataFrame:
        return assign.nodes_updates(labels_frame(self.spark, y), self.tree)

    @staticmethod
    def remap_tree_structure(tree: DataFrame) -> DataFrame:
        return tr.remap_tree(tree)


class PLT(_TreeModel):
    kind = "plt"

    def _fit_member(self, data, options):
        tree = self.given if self.given is not None else self._build(data, options.seed)
        self.tree = tree
        return (tree, *train_siblings(assign.sibling_groups(data, tree), tree, data.select("row_id", "features"), options))

    def _predict_member(self, rows, member, k, threshold, terms):
        number, own = _split_threshold(threshold)
        if self.extra.get("tree_search_type") == "beam":
            return predict.plt_beam(rows, *member, k, self.extra.get("beam_search_width", 10), number, self.options.loss, own, *terms)
        return predict.plt_predict(rows, *member, k, number, own, *terms, self.options.loss)

    def _score_pairs(self, rows, member, pairs, terms):
        return predict.apply_label_terms(predict.predict_for_label(rows, write_stage(pairs, "pairs"), *member, self.options.loss), *terms)

    def evaluated(self, x, top_k: int = 5) -> DataFrame:
        """``row_id, evaluated``: node estimators that a prediction scores, over all members."""
        rows = write_stage(self._rows(x), "rows")
        width = self.extra.get("beam_search_width", 10) if self.extra.get("tree_search_type") == "beam" else 0
        each = None
        for m in self.members:
            e = predict.evaluated_nodes(rows, *m, top_k, 0.0, self.options.loss, "hsm" if self.kind == "hsm" else "plt", width)
            each = e if each is None else each.unionByName(e)
        return each.groupBy("row_id").agg(F.sum("evaluated").alias("evaluated"))


class HSM(_TreeModel):
    kind = "hsm"

    def _fit_member(self, data, options):
        tree = self.given if self.given is not None else self._build(data, options.seed)
        self.tree = tree
        pick = self.extra.get("pick_one_label_weighting", True)
        models, weights = train_problems(assign.hsm_assignment(data, tree, pick), data.select("row_id", "features"), options)
        missing = tree.select("node_id").join(models.select("node_id"), "node_id", "left_anti")
        models = models.unionByName(missing.select("node_id", F.lit(0).alias("class_count"), F.lit(0).alias("first_class"), F.lit(0.0).alias("loss"), F.lit(0).cast("long").alias("n")))
        return tree, models, weights

    def _predict_member(self, rows, member, k, threshold, terms):
        number, own = _split_threshold(threshold)
        return predict.hsm_predict(rows, *member, k, self.options.loss, number, own, *terms)

    def _score_pairs(self, rows, member, pairs, terms):
        return predict.apply_label_terms(predict.hsm_predict_for_label(rows, write_stage(pairs, "pairs"), *member, self.options.loss), *terms)

    evaluated = PLT.evaluated


class BR(Model):
    kind = "br"

    def _fit_member(self, data, options):
        return (None, *train_one_vs_rest(data, options, inv_ps=self.inv_ps))

    def _predict_member(self, rows, member, k, threshold, terms):
        number, own = _split_threshold(threshold)
        return predict.br_predict(rows, member[1], member[2], k, number, own, terms[0], self.options.loss, terms[1])

    def _score_pairs(self, rows, member, pairs, terms):
        if predict.is_small(member[1], member[2]):  # scored in place, by the arithmetic of the members' own labels
            return super()._score_pairs(rows, member, pairs, terms)
        cand = pairs.select("row_id", F.col("label").alias("node_id"))
        v = predict.candidate_values(cand, predict.exploded(rows), member[1], member[2])
        s = v.select("row_id", F.col("node_id").alias("label"), predict.probability(F.col("value"), self.options.loss).alias("score"))
        return predict.apply_label_terms(s, *terms)


class OVR(BR):
    kind = "ovr"
    _score_pairs = Model._score_pairs  # a softmax needs all labels

    def _check_extra(self):
        if set(self.extra) - {"pick_one_label_weighting"}:
            raise TypeError(f"unknown parameters: {sorted(self.extra)}")

    def _fit_member(self, data, options):
        pick = self.extra.get("pick_one_label_weighting", True)
        if not pick and data.filter(F.size(F.array_distinct("labels")) > 1).take(1):
            raise ValueError("rows with several labels need pick-one weighting")
        return (None, *train_one_vs_rest(data, options, pick_one=True, inv_ps=self.inv_ps))

    def _predict_member(self, rows, member, k, threshold, terms):
        number, own = _split_threshold(threshold)
        if terms[1] is not None:
            raise ValueError("a softmax takes no label biases")
        return predict.ovr_predict(rows, member[1], member[2], k, terms[0], number, own)


class MACH(Model):
    """Merged averaged classifiers: one problem for each bucket of several label hashes."""

    kind = "mach"

    def _check_extra(self):
        if set(self.extra) - {"hashes", "buckets", "m"}:
            raise TypeError(f"unknown parameters: {sorted(self.extra)}")

    def _family(self, seed):
        return assign.mach_hashes(self.extra["m"], self.extra.get("hashes", 10), self.extra.get("buckets", 100), seed)

    def _fit_member(self, data, options):
        buckets = self.extra.get("buckets", 100)
        top = data.agg(F.max(F.array_max("labels"))).first()[0]
        self.extra["m"] = (top if top is not None else 0) + 1
        family = self._family(options.seed)
        # a bucket is a label of its own: the problems share the rows, and no grid is formed
        hit = assign.mach_assignment(data, family, buckets).groupBy("row_id").agg(F.collect_set((F.col("hash_no") * buckets + F.col("bucket")).cast("int")).alias("labels"))
        none = F.array().cast("array<int>")
        rows = data.select("row_id", "features").join(hit, "row_id", "left").select("row_id", F.coalesce("labels", none).alias("labels"), "features")
        models, weights = train_one_vs_rest(rows, options)
        bases = self.spark.range(len(family) * buckets).select(F.col("id").cast("int").alias("node_id"))
        empty = bases.join(models.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(1).alias("class_count"), F.lit(0).alias("first_class"), F.lit(0.0).alias("loss"), F.lit(data.count()).cast("long").alias("n"))
        labels = self.spark.range(self.extra["m"]).select(F.col("id").cast("int").alias("label"))
        table = assign.mach_buckets(labels, family, buckets)
        return write_stage(table.select("hash_no", "bucket", "label"), "machtable"), models.unionByName(empty), weights

    def _predict_member(self, rows, member, k, threshold, terms):
        table, models, weights = member
        buckets = self.extra.get("buckets", 100)
        v = predict.all_values(rows, models, weights)
        p = v.select("row_id", F.floor(F.col("node_id") / buckets).cast("int").alias("hash_no"), (F.col("node_id") % buckets).alias("bucket"), predict.probability(F.col("value"), self.options.loss).alias("p"))
        if terms[1] is not None:
            raise ValueError("merged classifiers take no label biases")
        return predict.mach_predict(p, table, k, terms[0], *_split_threshold(threshold))


class OPLT(_TreeModel):
    """A label tree that grows while it is trained, row after row; ``fit`` with ``resume`` goes on from the state."""

    kind = "oplt"

    def _check_extra(self):
        unknown = set(self.extra) - {"tree_search_type", "beam_search_width", "online_tree_alpha"}
        if unknown:
            raise TypeError(f"unknown parameters: {sorted(unknown)}")

    def __init__(self, spark, *, tree_type: str = "onlineBestScore", **kw):
        super().__init__(spark, tree_type=tree_type, **kw)
        if self.options.optimizer == "liblinear":
            self.options = replace(self.options, optimizer="adagrad")
        self.online = []

    def _options(self, seed: int):
        from .streaming.online_plt import OnlineOptions

        o, a = self.options, self.tree_args
        return OnlineOptions(a["arity"], a["max_leaves"], self.extra.get("online_tree_alpha", 0.5), a["kind"], o.optimizer, o.loss, o.eta, o.adagrad_eps, seed)

    def fit(self, x, y, inv_ps=None, resume: bool = False) -> Model:
        from .streaming.online_plt import OnlinePLT, advance, state_tables

        data = write_stage(labels_frame(self.spark, y).join(self._rows(x), "row_id"), "train")
        before = self.online if resume and self.online else [None] * max(1, self.ensemble)
        own = [self._options(self.options.seed + i) for i in range(len(before))]
        if self.given is not None and before[0] is None:
            none = self.spark.createDataFrame([], "node_id int, idx int, w double")
            before = [OnlinePLT.warm_start(self.given, none, o).state(self.spark) for o in own]
        self.online = [advance(data, o, s, self.options.epochs) for o, s in zip(own, before)]
        self.members = [state_tables(s) for s in self.online]
        self.tree = self.members[0][0]
        drop_stage(data)
        return self

    def save(self, path: str) -> None:
        super().save(path)
        for i, s in enumerate(self.online):
            s.write.mode("overwrite").parquet(f"{path}/member_{i}/state")

    @staticmethod
    def load_state(model: OPLT, path: str) -> OPLT:
        from .streaming.online_plt import STATE

        model.online = [model.spark.read.schema(STATE).parquet(f"{path}/member_{i}/state") for i in range(len(model.members))]
        return model

    _predict_member, _score_pairs, evaluated = PLT._predict_member, PLT._score_pairs, PLT.evaluated


class XT(_TreeModel):
    """A label tree over learned feature embeddings; a member is (tree, feature vectors, node weights)."""

    kind = "xt"

    def __init__(self, spark, *, tree_type: str = "huffman", dims: int = 100, bias: float = 0.0, norm: bool = False, epochs: int = 1, eta: float = 0.05, shards: int | None = None, **kw):
        super().__init__(spark, tree_type=tree_type, bias=bias, norm=norm, epochs=epochs, eta=eta, **kw)
        self.extra.update(dims=dims, shards=shards)

    def _fit_member(self, data, options):
        tree = self.given if self.given is not None else self._build(data, options.seed)
        self.tree = tree
        inputs, outputs = train_embedding_tree(data, tree, self.extra["dims"], options.epochs, options.eta, options.l2, self.extra["shards"], options.seed)
        return tree, inputs, outputs.select("node_id", F.posexplode("vec").alias("idx", "w"))

    def _predict_member(self, rows, member, k, threshold, terms):
        tree, inputs, weights = member
        number, own = _split_threshold(threshold)
        return predict.plt_predict(hidden_vectors(rows, inputs), tree, predict.given_models(tree), weights, k, number, own, *terms)

    def _score_pairs(self, rows, member, pairs, terms):
        tree, inputs, weights = member
        return predict.apply_label_terms(predict.predict_for_label(hidden_vectors(rows, inputs), write_stage(pairs, "pairs"), tree, predict.given_models(tree), weights), *terms)


def _split_threshold(threshold):
    """``(scalar, table or None)`` of a number or ``label, threshold``."""
    return (float(threshold), None) if isinstance(threshold, (int, float)) else (0.0, threshold)
