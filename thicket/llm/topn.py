"""Top N items of every group by score, with a fixed tie rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import top_positions
from ..plans.stages import write_stage


def counting_scores(predictions: DataFrame) -> DataFrame:
    """``run_id, row_id, label, score`` that count: the newest ``scored_at`` of each key.

    Null times are oldest; of equally new rows the highest score counts (NaN above
    all, null below).  Then null labels and null or NaN scores are left out.
    """
    one = predictions.select("run_id", "row_id", "label", "score", "scored_at").filter("label is not null")
    newest = one.groupBy("run_id", "row_id", "label").agg(F.max(F.struct("scored_at", "score")).alias("r"))
    return newest.select("run_id", "row_id", "label", "r.score").filter("score is not null and not isnan(score)")


def top_n_per_group(predictions: DataFrame, n: int = 5) -> DataFrame:
    """``run_id, row_id, label, score, position``: the first ``n`` labels by score descending, label ascending.

    Groups with null run or row ids are groups like others.  Empty input: no rows.
    The counting rows are written once: the sort reads them twice, to find its ranges and to sort.
    """
    return top_positions(write_stage(counting_scores(predictions), "counting"), ["run_id", "row_id"], [F.col("score").desc(), F.col("label").asc()], n)
