"""Ranking, propensity scored, set and macro metrics of multi-label predictions.

``truth(row_id, labels)`` is joined once to ``pred(row_id, labels)``, whose labels
are in rank order; a row without predictions has an empty ranking.  Everything per
row is computed on arrays in place, so each metric is one co-located join and one
small aggregate; only label-wise metrics shuffle exploded labels.  Labels may be
ints or strings.  Extra columns named in ``by`` give one result per group.

The set metrics and ``cli_metrics`` count every predicted label.  They also take
``pred`` long, as ``row_id, *by, label, score`` with each label once a row: it is
counted by (row, label), so that a row may have any number of predictions.

``semantics``: 'python' averages over all rows and counts empty truths as
``zero_division``; 'cli' leaves rows with nothing to measure out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import top_positions


def ranked(truth: DataFrame, pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``row_id, *by, t, p``: distinct true labels and the ranking; without nulls."""
    by = by or []
    t = truth.select("row_id", F.array_distinct(F.array_compact(F.coalesce("labels", F.array()))).alias("t"))
    p = pred.select("row_id", *by, F.array_compact("labels").alias("p"))
    j = t.join(p, "row_id", "inner" if by else "left")
    return j.select("row_id", *by, "t", F.coalesce("p", F.slice("t", 1, 0)).alias("p"))


def from_scores(scores: DataFrame, by: list[str] | None = None, k: int | None = None) -> DataFrame:
    """Long ``row_id, *by, label, score`` -> rankings by score descending, label ascending.

    With ``k`` only the first k of each row are kept, found by a global sort, so a row
    may have any number of scored labels; null and NaN scores are left out.
    """
    by = by or []
    s = _scored(scores, by)
    if k:
        s = top_positions(s, ["row_id", *by], [F.col("score").desc(), F.col("label").asc()], k)
        ranks = s.groupBy("row_id", *by).agg(F.array_sort(F.collect_list(F.struct("position", "label"))).alias("r"))
    else:
        ranks = s.groupBy("row_id", *by).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "label"))).alias("r"))
    return ranks.select("row_id", *by, F.col("r.label").alias("labels"))


def _scored(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.select("row_id", *by, "label", "score").filter("label is not null and score is not null and not isnan(score)")


def _is_long(pred: DataFrame) -> bool:
    return "labels" not in pred.columns


def _true(truth: DataFrame) -> DataFrame:
    return truth.select("row_id", F.explode(F.array_distinct(F.array_compact("labels"))).alias("label"))


def _hits(truth: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """``row_id, *by, label, hit`` of long predictions; joined by (row, label), so no row is in one place."""
    true = _true(truth).withColumn("hit", F.lit(1))
    return _scored(pred, by).drop("score").join(true, ["row_id", "label"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def _set_sizes(truth: DataFrame, pred: DataFrame, by: list[str] | None) -> DataFrame:
    """``row_id, *by, np, nt, tp``: predicted, true and common labels of each row."""
    by = by or []
    if not _is_long(pred):
        return ranked(truth, pred, by).select("row_id", *by, F.size("p").alias("np"), F.size("t").alias("nt"), F.size(F.array_intersect("t", "p")).alias("tp"))
    b = _hits(truth, pred, by).groupBy("row_id", *by).agg(F.count(F.lit(1)).alias("np"), F.sum("hit").alias("tp"))
    t = truth.select("row_id", F.size(F.array_distinct(F.array_compact(F.coalesce("labels", F.array())))).alias("nt"))
    none = F.lit(0).cast("long")
    return t.join(b, "row_id", "inner" if by else "left").select("row_id", *by, F.coalesce("np", none).alias("np"), "nt", F.coalesce("tp", none).alias("tp"))


def _at(r: DataFrame, k: int) -> DataFrame:
    hits = F.transform(F.slice("p", 1, k), lambda x: F.array_contains("t", x))
    return r.withColumn("h", hits).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k))))


def _gain(i: Column | int) -> Column:
    return F.lit(1.0) / F.log2(i + F.lit(1.0))


def _cumulate(weight) -> Column:
    """Sum over the first k places of ``weight(place)`` where the place is a hit."""
    places = F.transform(F.slice("h", F.lit(1), F.col("k")), lambda x, i: F.when(x, weight(i + 1)).otherwise(0.0))
    return F.aggregate(places, F.lit(0.0), lambda a, x: a + x)


def _average(r: DataFrame, value: Column, by, name: str) -> DataFrame:
    return r.groupBy(*(by or []), "k").agg(F.avg(value).alias(name))


def precision_at_k(truth, pred, k: int = 5, by=None) -> DataFrame:
    return _average(_at(ranked(truth, pred, by), k), _cumulate(lambda i: F.lit(1.0)) / F.col("k"), by, "precision")


def recall_at_k(truth, pred, k: int = 5, zero_division: float = 0, by=None, semantics: str = "python") -> DataFrame:
    r = _at(ranked(truth, pred, by), k)
    if semantics == "cli":
        r = r.filter(F.size("t") > 0)
    v = F.when(F.size("t") == 0, F.lit(float(zero_division))).otherwise(F.try_divide(_cumulate(lambda i: F.lit(1.0)), F.size("t")))
    return _average(r, v, by, "recall")


def dcg_at_k(truth, pred, k: int = 5, by=None) -> DataFrame:
    return _average(_at(ranked(truth, pred, by), k), _cumulate(_gain), by, "dcg")


def _ideal() -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.least(F.col("k"), F.size("t")), F.lit(1)))
    return F.aggregate(F.transform(places, _gain), F.lit(0.0), lambda a, x: a + x)


def ndcg_at_k(truth, pred, k: int = 5, zero_division: float = 0, by=None) -> DataFrame:
    v = F.when(F.size("t") == 0, F.lit(float(zero_division))).otherwise(_cumulate(_gain) / _ideal())
    return _average(_at(ranked(truth, pred, by), k), v, by, "ndcg")


def abandonment_at_k(truth, pred, k: int = 5, by=None) -> DataFrame:
    any_hit = F.array_contains(F.slice("h", F.lit(1), F.col("k")), True)
    return _average(_at(ranked(truth, pred, by), k), any_hit.cast("double"), by, "abandonment")


def hamming_loss(truth, pred, by=None) -> DataFrame:
    v = F.col("np") + F.col("nt") - 2 * F.col("tp")
    return _set_sizes(truth, pred, by).groupBy(*(by or [])).agg(F.avg(v).alias("hamming_loss"))


def _weighted(truth, pred, inv_ps: DataFrame, k: int, by) -> DataFrame:
    """Adds the weights of the ranking ``q`` and the true labels' weights descending ``best``.

    The label weights are joined to exploded labels (a plain equi-join, as there may
    be millions of labels); a label without weight has 0.
    """
    by = by or []
    r = ranked(truth, pred, by)
    q = inv_ps.select("label", F.col("inv_ps").cast("double").alias("q"))
    places = r.select("row_id", *by, F.posexplode(F.slice("p", 1, k)).alias("i", "label")).join(q, "label", "left")
    pq = places.groupBy("row_id", *by).agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("q", F.lit(0.0)).alias("q")))).alias("x"))
    tq = truth.select("row_id", F.explode(F.array_distinct(F.array_compact("labels"))).alias("label")).join(q, "label", "left")
    tq = tq.groupBy("row_id").agg(F.reverse(F.array_sort(F.collect_list(F.coalesce("q", F.lit(0.0))))).alias("best"))
    none = F.array().cast("array<double>")
    return r.join(pq, ["row_id", *by], "left").join(tq, "row_id", "left").withColumns({"q": F.coalesce("x.q", none), "best": F.coalesce("best", none)})


def _ps(truth, pred, inv_ps, k, by, weight, divide, normalize, zero_division, name) -> DataFrame:
    r = _at(_weighted(truth, pred, inv_ps, k, by), k)
    got = F.aggregate(
        F.transform(F.slice("h", F.lit(1), F.col("k")), lambda x, i: F.when(x, F.get("q", i) * weight(i + 1)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x
    )
    top = F.aggregate(F.transform(F.slice("best", F.lit(1), F.col("k")), lambda x, i: x * weight(i + 1)), F.lit(0.0), lambda a, x: a + x)
    if zero_division is None:
        a, b = got / divide, top / divide
    else:
        a, b = (F.when(F.size("t") == 0, F.lit(float(zero_division))).otherwise(F.try_divide(v, divide)) for v in (got, top))
    s = r.groupBy(*(by or []), "k").agg(F.sum(a).alias("a"), F.sum(b).alias("b"), F.count(F.lit(1)).alias("n"))
    return s.select(*(by or []), "k", F.try_divide("a", "b" if normalize else "n").alias(name))


def psprecision_at_k(truth, pred, inv_ps, k: int = 5, normalize: bool = True, by=None) -> DataFrame:
    return _ps(truth, pred, inv_ps, k, by, lambda i: F.lit(1.0), F.col("k"), normalize, None, "psprecision")


def psrecall_at_k(truth, pred, inv_ps, k: int = 5, normalize: bool = True, zero_division: float = 0, by=None) -> DataFrame:
    return _ps(truth, pred, inv_ps, k, by, lambda i: F.lit(1.0), F.size("t"), normalize, zero_division, "psrecall")


def psdcg_at_k(truth, pred, inv_ps, k: int = 5, normalize: bool = True, by=None) -> DataFrame:
    """Divided by the cut as well, as this metric is defined here (plain DCG is not)."""
    return _ps(truth, pred, inv_ps, k, by, _gain, F.col("k"), normalize, None, "psdcg")


def psndcg_at_k(truth, pred, inv_ps, k: int = 5, zero_division: float = 0, normalize: bool = True, by=None) -> DataFrame:
    return _ps(truth, pred, inv_ps, k, by, _gain, _ideal(), normalize, zero_division, "psndcg")


def coverage_at_k(truth, pred, k: int = 5, by=None, outputs: int | None = None) -> DataFrame:
    """Distinct labels hit in the first k places over distinct true labels (or ``outputs``).

    One row per distinct (label, best place) is shuffled, not one per hit and cut.
    """
    by = by or []
    r = ranked(truth, pred, by)
    first = r.select(*by, "t", F.posexplode(F.slice("p", 1, k)).alias("i", "label")).filter(F.array_contains("t", F.col("label")))
    place = first.groupBy(*by, "label").agg((F.min("i") + 1).alias("place"))
    hit = place.withColumn("k", F.explode(F.sequence(F.col("place"), F.lit(k)))).groupBy(*by, "k").agg(F.count(F.lit(1)).alias("hits"))
    seen = r.select(*by, F.explode("t").alias("label")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("seen"))
    cuts = seen.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k))))
    of = F.lit(outputs) if outputs else F.col("seen")
    return cuts.join(hit, [*by, "k"], "left").select(*by, "k", (F.coalesce("hits", F.lit(0)) / of).alias("coverage"))


def micro_f1(truth, pred, by=None) -> DataFrame:
    r = _set_sizes(truth, pred, by)
    s = r.groupBy(*(by or [])).agg(F.sum("tp").alias("tp"), F.sum(F.col("np") + F.col("nt")).alias("all"))
    return s.select(*(by or []), F.try_divide(2 * F.col("tp"), "all").alias("micro_f1"))


def samples_f1(truth, pred, zero_division: float = 0, by=None, semantics: str = "python") -> DataFrame:
    r = _set_sizes(truth, pred, by)
    prec = F.when(F.col("np") > 0, F.try_divide("tp", "np")).otherwise(0.0)
    rec = F.when(F.col("nt") > 0, F.try_divide("tp", "nt")).otherwise(F.lit(float(zero_division)))
    r = r.withColumns({"pr": prec, "re": rec})
    if semantics == "cli":
        r = r.filter("pr > 0 and re > 0")
    v = F.when(F.col("re") > 0, F.try_divide(2 * F.col("pr") * F.col("re"), F.col("pr") + F.col("re"))).otherwise(F.lit(float(zero_division)))
    return r.groupBy(*(by or [])).agg(F.avg(v).alias("samples_f1"))


def confusion_counts(truth, pred, by=None) -> DataFrame:
    """``*by, label, tp, fp, fn`` of every label that is true or predicted somewhere."""
    if _is_long(pred):
        return _long_confusion(truth, pred, by or [])
    r = ranked(truth, pred, by)
    kind = lambda arr, name: F.transform(arr, lambda x: F.struct(x.alias("label"), F.lit(name).alias("kind")))
    every = F.concat(kind(F.array_intersect("t", "p"), "tp"), kind(F.array_except("p", "t"), "fp"), kind(F.array_except("t", "p"), "fn"))
    e = r.select(*(by or []), F.explode(every).alias("e")).select(*(by or []), "e.label", "e.kind")
    count = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(k)
    return e.groupBy(*(by or []), "label").agg(count("tp"), count("fp"), count("fn"))


def _long_confusion(truth, pred, by: list[str]) -> DataFrame:
    h = _hits(truth, pred.join(truth.select("row_id"), "row_id", "left_semi"), by)
    rows = h.select("row_id", *by).distinct() if by else truth.select("row_id")
    zero = F.lit(0).cast("long")
    said = h.groupBy(*by, "label").agg(F.sum("hit").alias("tp"), F.sum(1 - F.col("hit")).alias("fp")).withColumn("t", zero)
    true = rows.join(_true(truth), "row_id").groupBy(*by, "label").agg(F.count(F.lit(1)).alias("t")).withColumns({"tp": zero, "fp": zero})
    c = said.unionByName(true).groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("t").alias("t"))
    return c.select(*by, "label", "tp", "fp", (F.col("t") - F.col("tp")).alias("fn"))


def _macro(c: DataFrame, keys: list[str], numeric: bool, outputs: int | None, zero_division: float, values: dict) -> DataFrame:
    """Averages over labels 0..max (ints) or the labels seen (text); absent ones count ``zero_division``."""
    terms = {n: F.when(d > 0, F.try_divide(v, d)).otherwise(F.lit(float(zero_division))) for n, (v, d) in values.items()}
    agg = c.groupBy(*keys).agg(*[F.sum(t).alias(n) for n, t in terms.items()], F.count(F.lit(1)).alias("_seen"), F.max("label").alias("_top"))
    size = F.lit(outputs) if outputs else (F.col("_top") + 1 if numeric else F.col("_seen"))
    return agg.select(*keys, *[((F.col(n) + (size - F.col("_seen")) * float(zero_division)) / size).alias(n) for n in terms])


def _is_numeric(truth) -> bool:
    return truth.schema["labels"].dataType.elementType.typeName() in ("integer", "long", "short")


def macro_f1(truth, pred, zero_division: float = 0, by=None, outputs: int | None = None) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return _macro(confusion_counts(truth, pred, by), list(by or []), _is_numeric(truth), outputs, zero_division, {"macro_f1": (2 * tp, 2 * tp + fp + fn)})


def f1_measure(truth, pred, average: str = "micro", zero_division: float = 0, by=None) -> DataFrame:
    if average == "micro":
        return micro_f1(truth, pred, by)
    if average == "macro":
        return macro_f1(truth, pred, zero_division, by)
    if average in ("samples", "sample"):
        return samples_f1(truth, pred, zero_division, by)
    raise ValueError("average should be micro, macro or samples")


def macro_at_k(truth, pred, k: int = 5, zero_division: float = 0, by=None) -> DataFrame:
    """Macro precision, recall and F1 of the first 1..k places."""
    by = by or []
    r = _at(ranked(truth, pred, by), k).withColumn("c", F.slice("p", F.lit(1), F.col("k")))
    kind = lambda arr, name: F.transform(arr, lambda x: F.struct(x.alias("label"), F.lit(name).alias("kind")))
    every = F.concat(kind(F.array_intersect("t", "c"), "tp"), kind(F.array_except("c", "t"), "fp"), kind(F.array_except("t", "c"), "fn"))
    e = r.select(*by, "k", F.explode(every).alias("e")).select(*by, "k", "e.label", "e.kind")
    count = lambda x: F.sum((F.col("kind") == x).cast("long")).alias(x)
    c = e.groupBy(*by, "k", "label").agg(count("tp"), count("fp"), count("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return _macro(c, [*by, "k"], _is_numeric(truth), None, zero_division, {
        "macro_precision": (tp, tp + fp), "macro_recall": (tp, tp + fn), "macro_f1": (2 * tp, 2 * tp + fp + fn)})


def cli_metrics(truth, pred, k: int = 5, outputs: int | None = None, by=None) -> DataFrame:
    """The command line's per-row metrics in one pass: ``metric, value, std``.

    p@k r@k dcg@k ndcg@k tp@k tp fp fn p r hl samplef1 acc s; each an average over
    the rows that it is defined for, with the standard deviation.
    """
    by = by or []
    if _is_long(pred):
        r, sizes = ranked(truth, from_scores(pred, by, k), by), _set_sizes(truth, pred, by).drop("nt")
        keys = ["row_id", *by]
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
        r = r.alias("a").join(sizes.alias("b"), same).select(*[f"a.{c}" for c in keys], "t", "p", "np", "tp")
    else:
        r = ranked(truth, pred, by).withColumns({"np": F.size("p"), "tp": F.size(F.array_intersect("t", "p"))})
    r = r.withColumn("k", F.lit(k)).withColumn("tp", F.col("tp").cast("double"))
    r = r.withColumn("h", F.transform(F.slice("p", 1, k), lambda x: F.array_contains("t", x)))
    np_, nt = F.col("np"), F.size("t")
    hits = _cumulate(lambda i: F.lit(1.0))
    prec, rec = F.when(np_ > 0, F.try_divide("tp", np_)), F.when(nt > 0, F.try_divide("tp", nt))
    both = (np_ > 0) & (nt > 0) & (F.col("tp") > 0)
    values = {
        f"p@{k}": hits / k, f"r@{k}": F.when(nt > 0, F.try_divide(hits, nt)), f"dcg@{k}": _cumulate(_gain),
        f"ndcg@{k}": F.when(nt > 0, _cumulate(_gain) / _ideal()).otherwise(0.0), f"tp@{k}": hits, "tp": F.col("tp"),
        "fp": np_ - F.col("tp"), "fn": nt - F.col("tp"), "p": prec, "r": rec, "hl": np_ + nt - 2 * F.col("tp"),
        "samplef1": F.when(both, F.try_divide(2 * prec * rec, prec + rec)),
        "acc": F.when(nt > 0, (F.get("t", F.lit(0)) == F.get("p", F.lit(0))).cast("double")).otherwise(0.0), "s": np_.cast("double"),
    }
    acc = F.coalesce(values["acc"], F.lit(0.0))
    values["acc"] = acc
    e = r.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("v")) for n, v in values.items()])).alias("e"))
    return e.filter("e.v is not null").groupBy(*by, "e.metric").agg(F.avg("e.v").alias("value"), F.stddev_pop("e.v").alias("std"))
