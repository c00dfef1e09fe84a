"""Online F-measure optimisation of decision thresholds.

The exact form is a fold over rows in order, because each row is cut with the
thresholds that the rows before it have made.  A fold streams ``row_id, labels,
probs`` (all label probabilities) in sorted order through one task, whose memory
holds one batch and the counters.  ``macro_ofo_blocks`` is the parallel
form: counters per label are updated by one aggregate per block of rows, with
thresholds fixed inside a block (an approximation that shrinks with the block).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import write_stage


def _fold(rows: DataFrame, epochs: int, kernel, schema: str) -> DataFrame:
    """Run ``kernel`` over all rows in order of (epoch, row_id): the engine sorts, one task streams."""
    d = rows.select("row_id", F.coalesce("labels", F.array().cast("array<int>")).alias("y"), F.col("probs.label").alias("x"), F.col("probs.score").alias("p"))
    d = d.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).repartition(1).sortWithinPartitions("epoch", "row_id")
    return d.select("y", "x", "p").mapInArrow(kernel, schema)


def _rows(batches):
    """``(distinct true labels, predicted labels, probabilities)`` of each row as arrays."""
    import numpy as np

    for b in batches:
        cols = [b.column(i) for i in range(3)]
        ends = [np.r_[0, np.cumsum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))] for c in cols]
        flat = [c.flatten().to_numpy(zero_copy_only=False) for c in cols]
        for r in range(b.num_rows):
            y, x, p = (f[e[r] : e[r + 1]] for f, e in zip(flat, ends))
            yield np.unique(y), x, p


def micro_ofo(rows: DataFrame, a: float = 10.0, b: float = 20.0, epochs: int = 1) -> float:
    """One threshold a / b: hits raise a; predictions and true labels raise b."""

    def fold(batches):
        import numpy as np

        hits, both = a, b
        for y, x, p in _rows(batches):
            said = x[p >= hits / both]
            hits += int(np.isin(said, y).sum())
            both += len(said) + len(y)
        yield pa.RecordBatch.from_arrays([pa.array([hits / both])], names=["threshold"])

    return _fold(rows, epochs, fold, "threshold double").first()[0]


def macro_ofo(rows: DataFrame, a: float = 10.0, b: float = 20.0, epochs: int = 1) -> DataFrame:
    """``label, threshold`` of each label met; the others keep a / b and have no line."""

    def fold(batches):
        import numpy as np

        slot: dict[int, int] = {}
        num, den, met = np.full(1024, a), np.full(1024, b), np.zeros(1024, bool)
        for y, x, p in _rows(batches):
            jy, jx = (np.array([slot.setdefault(v, len(slot)) for v in z.tolist()], np.int64) for z in (y, x))
            if len(slot) > len(num):
                more = 2 * len(slot) - len(num)
                num, den, met = np.r_[num, np.full(more, a)], np.r_[den, np.full(more, b)], np.r_[met, np.zeros(more, bool)]
            said = jx[p >= num[jx] / den[jx]]
            den[said] += 1
            num[said[np.isin(said, jy)]] += 1
            den[jy] += 1
            met[said] = met[jy] = True
        known = np.array(list(slot), np.int32)
        own = met[: len(known)]
        yield pa.RecordBatch.from_arrays([pa.array(known[own]), pa.array((num / den)[: len(known)][own])], names=["label", "threshold"])

    return _fold(rows, epochs, fold, "label int, threshold double")


def mixed_ofo(rows: DataFrame, priors: DataFrame, top: int = 1000, a: float = 10.0, b: float = 20.0, epochs: int = 1) -> DataFrame:
    """``label, threshold``: the macro one for the ``top`` most frequent labels, the micro one elsewhere."""
    macro = write_stage(macro_ofo(rows, a, b, epochs), "ofo")
    micro = micro_ofo(rows, a, b, 1)
    head = priors.orderBy(F.col("prior").desc(), "label").limit(top).select("label")
    table = head.join(macro, "label", "left").select("label", F.coalesce("threshold", F.lit(a / b)).alias("m"))
    return priors.join(table, "label", "left").select("label", F.coalesce("m", F.lit(micro)).alias("threshold"))


def macro_ofo_blocks(long: DataFrame, block: DataFrame, blocks: int, a: float = 10.0, b: float = 20.0) -> DataFrame:
    """``long(row_id, label, score, y)``, ``block(row_id, block)`` -> ``label, threshold``, block by block."""
    d = write_stage(long.join(block, "row_id"), "ofo")
    state = d.select("label").distinct().select("label", F.lit(a).alias("a"), F.lit(b).alias("b"))
    for k in range(blocks):
        hit = d.filter(F.col("block") == k).join(state, "label").withColumn("p", (F.col("score") >= F.col("a") / F.col("b")).cast("double"))
        new = hit.groupBy("label").agg(F.sum(F.col("p") * F.col("y")).alias("da"), F.sum(F.col("p") + F.col("y")).alias("db"))
        state = write_stage(state.join(new, "label", "left").select("label", (F.col("a") + F.coalesce("da", F.lit(0.0))).alias("a"), (F.col("b") + F.coalesce("db", F.lit(0.0))).alias("b")), "ofo")
    return state.select("label", (F.col("a") / F.col("b")).alias("threshold"))
