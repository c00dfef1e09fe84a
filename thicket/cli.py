"""Command line: train, test, predict, ofo, testPredictionTime, version.

    spark-submit -m thicket.cli train -i train.txt -o model --model plt --arity 16
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .models import BR, HSM, MACH, OPLT, OVR, PLT, XT, Model
from .operators import metrics as mx
from .sources.files import read_libsvm, read_vector, write_predictions, write_vector

KINDS = {"plt": PLT, "hsm": HSM, "br": BR, "ovr": OVR, "mach": MACH, "oplt": OPLT, "extremeText": XT}
#: Options that choose how the work is carried out elsewhere; the engine decides that itself, so they change nothing here.
EXECUTION = ("ensOnTheTrot", "batchRows", "beamSearchUnpack", "threads")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="thicket")
    p.add_argument("command", choices=["train", "test", "predict", "ofo", "testPredictionTime", "version"])
    p.add_argument("-i", "--input")
    p.add_argument("-o", "--output")
    p.add_argument("-m", "--model", default="plt", choices=sorted(KINDS))
    for flag, kind, default in (
        ("seed", int, 42), ("ensemble", int, 0), ("ensMissingScores", int, 1), ("hash", int, 0), ("bias", float, 1.0), ("norm", int, 1), ("featuresThreshold", float, 0.0), ("eps", float, 0.1), ("cost", float, 10.0),
        ("maxIter", int, 100), ("loss", str, "logistic"), ("solver", str, None), ("optimizer", str, "liblinear"), ("weightsThreshold", float, 0.1), ("eta", float, 1.0), ("epochs", int, 1),
        ("tmax", int, -1), ("l2Penalty", float, 0.0), ("adagradEps", float, 0.001), ("arity", int, 2), ("treeType", str, None), ("maxLeaves", int, 100), ("flattenTree", int, 0),
        ("kmeansEps", float, 0.0001), ("kmeansBalanced", int, 1), ("kmeansWeightedFeatures", int, 0), ("onlineTreeAlpha", float, 0.5), ("dims", int, 100), ("resume", int, 0), ("saveGrads", int, 1), ("topK", int, None), ("threshold", float, 0.0), ("treeSearchType", str, "exact"), ("beamSearchWidth", int, 10),
        ("startRow", int, None), ("endRow", int, None), ("metrics", str, "p@1,p@3,p@5"), ("ofoType", str, "micro"), ("ofoA", float, 10.0), ("ofoB", float, 20.0), ("ofoTopLabels", int, 1000),
        ("labelsWeights", str, None), ("thresholds", str, None), ("pickOneLabelWeighting", int, 1), ("machHashes", int, 10), ("machBuckets", int, 100),
    ):
        p.add_argument(f"--{flag}", type=kind, default=default)
    for flag in EXECUTION:
        p.add_argument(f"--{flag}", type=int, default=None)
    return p


def build(spark: SparkSession, a) -> Model:
    kw = dict(bias=a.bias, norm=bool(a.norm), hash=a.hash, features_threshold=a.featuresThreshold, ensemble=a.ensemble, ens_missing_scores=bool(a.ensMissingScores), optimizer=a.optimizer, loss=a.loss, cost=a.cost, eps=a.eps, max_iter=a.maxIter,
              weights_threshold=a.weightsThreshold, eta=a.eta, epochs=a.epochs, tmax=a.tmax, l2=a.l2Penalty, adagrad_eps=a.adagradEps, seed=a.seed)
    if a.solver:
        kw["solver"] = a.solver
    if a.model in ("plt", "hsm", "oplt", "extremeText"):
        kw.update(tree_type=a.treeType or {"oplt": "onlineBestScore", "extremeText": "huffman"}.get(a.model, "hierarchicalKmeans"), kmeans_weighted_features=bool(a.kmeansWeightedFeatures), arity=a.arity, max_leaves=a.maxLeaves, flatten_tree=a.flattenTree, kmeans_eps=a.kmeansEps, kmeans_balanced=bool(a.kmeansBalanced))
    if a.model == "oplt":
        kw["online_tree_alpha"] = a.onlineTreeAlpha
    if a.model == "extremeText":
        kw.update(dims=a.dims, bias=0.0, norm=False)
    if a.model in ("plt", "oplt"):
        kw.update(tree_search_type=a.treeSearchType, beam_search_width=a.beamSearchWidth)
    if a.model == "mach":
        kw.update(hashes=a.machHashes, buckets=a.machBuckets)
    if a.model in ("hsm", "ovr"):
        kw["pick_one_label_weighting"] = bool(a.pickOneLabelWeighting)
    return KINDS[a.model](spark, **kw)


def metric_values(truth, pred, names: list[str]) -> dict[str, float]:
    out = {}
    ks = sorted({int(n.split("@")[1]) for n in names if "@" in n} or {1})
    tables = {k: {r["metric"]: r["value"] for r in mx.cli_metrics(truth, pred, k).collect()} for k in ks}
    for n in names:
        base = n.replace("precision", "p").replace("recall", "r")
        if base == "microf1":
            out[n] = mx.micro_f1(truth, pred).first()[0]
        elif base == "macrof1":
            out[n] = mx.macro_f1(truth, pred, 1.0).first()[0]
        elif base.startswith("c@"):
            k = int(base[2:])
            out[n] = mx.coverage_at_k(truth, pred, k).filter(F.col("k") == k).first()["coverage"]
        else:
            k = int(base.split("@")[1]) if "@" in base else ks[0]
            out[n] = tables[k].get(base)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    if a.command == "version":
        print(__version__)
        return {"version": __version__}
    spark = spark or SparkSession.builder.appName("thicket").getOrCreate()
    start = time.time()
    data = read_libsvm(spark, a.input, raw=True, start_row=a.startRow, end_row=a.endRow)
    if a.command == "train":
        if a.resume and a.model != "oplt":
            raise SystemExit("only oplt goes on from a saved state")
        # the state of an online model always holds its gradients
        m = Model.load(spark, a.output).fit(data, data, resume=True) if a.resume else build(spark, a).fit(data, data)
        m.save(a.output)
        return _say({"rows": data.count(), "seconds": time.time() - start})
    m = Model.load(spark, a.output)
    if a.thresholds:
        m.set_thresholds(read_vector(spark, a.thresholds).withColumnRenamed("value", "threshold"))
    weights = read_vector(spark, a.labelsWeights).withColumnRenamed("value", "weight") if a.labelsWeights else None
    top = a.topK if a.topK is not None else (0 if a.threshold > 0 else 5)
    if a.command == "predict":
        pred = m.predict_proba(data, top_k=top, threshold=a.threshold, labels_weights=weights)
        rows = pred.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "label", "score"))).alias("pred"))
        write_predictions(rows.select("row_id", F.transform("pred", lambda p: F.struct(p["label"].alias("label"), p["score"].alias("score"))).alias("pred")), f"{a.output}/predictions-{int(start)}")
        return _say({"seconds": time.time() - start})
    if a.command == "test":
        return _say({**metric_values(data, m.predict(data, top_k=top, threshold=a.threshold, labels_weights=weights), a.metrics.split(",")), "seconds": time.time() - start})
    if a.command == "testPredictionTime":
        return _say(prediction_time(m, data))
    from .operators.labels import labels_priors
    from .streaming.ofo import macro_ofo, micro_ofo, mixed_ofo

    probs = m.predict_proba(data, top_k=0).groupBy("row_id").agg(F.collect_list(F.struct("label", "score")).alias("probs"))
    rows = data.select("row_id", "labels").join(probs, "row_id", "left")
    priors = labels_priors(data)
    if a.ofoType == "micro":
        table = priors.select("label", F.lit(micro_ofo(rows, a.ofoA, a.ofoB, a.epochs)).alias("value"))
    elif a.ofoType == "macro":
        table = priors.join(macro_ofo(rows, a.ofoA, a.ofoB, a.epochs), "label", "left").select("label", F.coalesce("threshold", F.lit(a.ofoA / a.ofoB)).alias("value"))
    else:
        table = mixed_ofo(rows, priors, a.ofoTopLabels, a.ofoA, a.ofoB, a.epochs).select("label", F.col("threshold").alias("value"))
    write_vector(table, f"{a.output}/thresholds")
    return _say({"seconds": time.time() - start})


def prediction_time(m: Model, data, batches: int = 10, sizes: tuple = (100, 1000, 10000)) -> dict:
    """Mean and standard deviation of seconds for ``batches`` seeded random batches of each size."""
    from statistics import mean, pstdev

    out = {}
    for size in sizes:
        took = []
        for b in range(batches):
            part = data.orderBy(F.xxhash64("row_id", F.lit(b))).limit(size)
            t = time.time()
            m.predict_proba(part).write.format("noop").mode("overwrite").save()
            took.append(time.time() - t)
        out[str(size)] = {"mean_s": mean(took), "std_s": pstdev(took), "ms_per_row": 1000 * mean(took) / size}
    return out


def _say(result: dict) -> dict:
    print(json.dumps(result))
    return result


if __name__ == "__main__":
    main()
