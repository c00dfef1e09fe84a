"""Exact positions inside groups of any size, from one global sort."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import write_stage


def top_positions(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """Rows of ``df`` at positions 1..n of their group under ``order`` (a total order), plus ``position``.

    ``df`` is range-partitioned and sorted on (group, order), so a group of any size
    lies in consecutive partitions and no task holds more than its share.  One pass
    over each sorted partition counts its groups and keeps the rows that can still
    be within ``n``.  A group that crosses partitions is the last of one and the
    first of the next, so at most two counts a partition are prefix-summed into the
    offsets that turn local into exact positions.  Null group keys are groups too.
    """
    cols = df.columns
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order).sortWithinPartitions(*[F.col(g) for g in group], *order)
    local = write_stage(_local_positions(ranged, group, n), "positions")
    w = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    edges = local.filter("_edge and _local = 1").select("_pid", *group, "_count")
    offset = edges.withColumn("_before", F.coalesce(F.sum("_count").over(w), F.lit(0))).filter("_before > 0").drop("_count")
    cond = F.col("l._pid") == F.col("o._pid")
    for g in group:
        cond = cond & F.col(f"l.{g}").eqNullSafe(F.col(f"o.{g}"))
    inner = local.filter("not _edge").select(*cols, F.col("_local").alias("position"))
    crossing = local.filter("_edge").alias("l").join(offset.alias("o"), cond, "left")
    exact = (F.col("_local") + F.coalesce("_before", F.lit(0))).alias("position")
    return inner.unionByName(crossing.select(*[F.col(f"l.{c}") for c in cols], exact).filter(F.col("position") <= n))


def _local_positions(ranged: DataFrame, group: list[str], n: int) -> DataFrame:
    cols = ranged.columns
    keys = [cols.index(g) for g in group]
    extra = {"_pid": F.lit(0), "_local": F.lit(0).cast("long"), "_count": F.lit(0).cast("long"), "_edge": F.lit(False)}
    names = [*cols, *extra]

    def number(batches):
        import numpy as np
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        rows, key, size, first = None, None, 0, True  # the group still open, cut to n rows, and its size so far

        def out(b, local, count, edge):
            k = len(local)
            tail = [pa.array(np.full(k, pid, np.int32)), pa.array(np.asarray(local, np.int64)), pa.array(np.asarray(count, np.int64)), pa.array(np.asarray(edge, bool))]
            return pa.RecordBatch.from_arrays([*b.columns, *tail], names=names)

        def close(edge):
            k = rows.num_rows
            return out(rows, np.arange(1, k + 1), np.full(k, size), np.full(k, edge))

        def at(b, i):
            return tuple(b.column(k)[i].as_py() for k in keys)

        for b in batches:
            m = b.num_rows
            if not m:
                continue
            change = np.zeros(m, bool)
            for k in keys:
                a = b.column(k)
                null = a.is_null().to_numpy(zero_copy_only=False)
                v = a.to_numpy(zero_copy_only=False) if not a.null_count else np.array([None if x is None else x for x in a.to_pylist()], object)
                change[1:] |= (v[1:] != v[:-1]) | (null[1:] != null[:-1])
            starts = np.flatnonzero(np.r_[True, change[1:]])
            ends = np.r_[starts[1:], m]
            lead = int(rows is not None and at(b, 0) == key)
            if lead:
                need = min(max(0, n - rows.num_rows), int(ends[0]))
                if need:
                    rows = pa.Table.from_batches([rows, b.slice(0, need)]).combine_chunks().to_batches()[0]
                size += int(ends[0])
                if len(starts) == 1:
                    continue
            if rows is not None:
                yield close(first)
                first = False
            s, e = starts[lead:-1], ends[lead:-1]
            if len(s):
                width = np.minimum(e - s, n)
                loc = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                edge = np.zeros(len(loc), bool)
                if first:
                    edge[: width[0]] = True
                    first = False
                yield out(b.take(pa.array(np.repeat(s, width) + loc)), loc + 1, np.repeat(e - s, width), edge)
            s = int(starts[-1])
            rows, size, key = b.slice(s, min(n, m - s)), m - s, at(b, s)
        if rows is not None:
            yield close(True)

    return ranged.mapInArrow(number, ranged.withColumns(extra).schema)
