"""Running sums inside groups of any size, from one global sort."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import write_stage


def running_sums(df: DataFrame, group: str, order: list[Column], value: str) -> DataFrame:
    """Adds ``running``: the sum of long ``value`` up to and including the row, in its group under ``order``.

    Range-partitioned and sorted on (group, order); a pass over each partition sums
    locally, and the sums of a group's earlier partitions (one row for each group in
    each partition) are added.  ``group`` must not be null.
    """
    cols = df.columns
    keys = [F.col(group), *order]
    srt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    g, v = cols.index(group), cols.index(value)

    def accumulate(batches):
        import numpy as np
        from pyspark import TaskContext

        pid, last, total = TaskContext.get().partitionId(), None, 0
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            keys = np.array(b.column(g).to_pylist(), object)
            size = b.column(v).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            run = np.cumsum(size)
            base = np.r_[0, run][starts]
            local = run - np.repeat(base, np.diff(np.r_[starts, m]))
            if last is not None and keys[0] == last:
                local[: starts[1] if len(starts) > 1 else m] += total
            last, total = keys[-1], int(local[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(m, pid, np.int32)), pa.array(local)], names=[*cols, "_pid", "_local"])

    local = write_stage(srt.mapInArrow(accumulate, srt.withColumns({"_pid": F.lit(0), "_local": F.lit(0).cast("long")}).schema), "running")
    sums = local.groupBy("_pid", group).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_pid", group, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before")).filter("_before <> 0")
    return local.join(before, ["_pid", group], "left").select(*cols, (F.col("_local") + F.coalesce("_before", F.lit(0))).alias("running"))
