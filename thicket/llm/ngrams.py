"""Occurrence and record counts of every distinct item or item n-gram.

Each Arrow batch of whole records becomes a suffix array bounded to ``max_n``
items: suffixes sorted by their leading items and then by record, with the common
prefix length of neighbours.  A run of neighbours sharing at least n items is one
n-gram; its length is the number of occurrences, and every adjacency inside it
within one record is taken off to give the number of records.  As a record is
never split, the local counts of a batch add up; Spark sums them with map-side
combining, so an item held by a third of all records costs no more than one row
per batch in the shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _suffix_intervals(values, record, max_n):
    """Sorted runs of equal n-grams: yields ``(n, grams (k x n), occurrences, records)``."""
    import numpy as np

    m = len(values)
    low = np.iinfo(np.int64).min  # ends a record; sorts before every item
    cols = []
    for k in range(max_n):
        c = np.full(m, low, np.int64)
        if m > k:
            same = record[k:] == record[: m - k]
            c[: m - k][same] = values[k:][same]
        cols.append(c)
    order = np.lexsort((record, *cols[::-1]))
    cols, rec = [c[order] for c in cols], record[order]
    equal = np.ones(max(m - 1, 0), bool)
    for n in range(1, max_n + 1):
        equal = equal & (cols[n - 1][1:] == cols[n - 1][:-1])  # common prefix of at least n
        whole = cols[n - 1] != low if n > 1 else np.ones(m, bool)
        starts = np.flatnonzero(np.r_[True, ~equal]) if m else np.zeros(0, int)
        keep = whole[starts]
        size = np.diff(np.r_[starts, m])
        run = np.cumsum(np.r_[True, ~equal]) if m else size
        r = rec if n == max_n else rec[np.lexsort((rec, run))]  # within a run by record, for every depth
        dup = np.cumsum(np.r_[0, 0, equal & (r[1:] == r[:-1])]) if m else np.zeros(2, int)
        # duplicate adjacencies strictly inside each run
        inside = dup[starts + size] - dup[starts + 1]
        yield n, np.stack([c[starts][keep] for c in cols[:n]], 1) if m else np.zeros((0, n), np.int64), size[keep], (size - inside)[keep]


def sequence_counts(df: DataFrame, sequences: dict[str, str], max_n: int = 1) -> DataFrame:
    """Counts over array<long> columns of ``df``, one row being one record.

    ``sequences`` maps a kind to its column.  Returns ``item_kind, n, gram,
    occurrences, records``.  Null members and null arrays hold nothing; an n-gram
    spans the gap that a null member leaves.  An empty table gives no rows.
    """
    kinds = list(sequences)
    data = df.select(*[F.col(sequences[k]).cast("array<bigint>").alias(f"c{i}") for i, k in enumerate(kinds)])

    def count(batches):
        import numpy as np

        for b in batches:
            for i, kind in enumerate(kinds):
                a = b.column(i)
                width = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = a.flatten()
                record = np.repeat(np.arange(len(width)), width)
                if flat.null_count:
                    ok = flat.is_valid().to_numpy(zero_copy_only=False)
                    record, flat = record[ok], flat.drop_null()
                for n, grams, occ, recs in _suffix_intervals(flat.to_numpy(zero_copy_only=False).astype(np.int64), record, max_n):
                    if len(grams):
                        arr = pa.ListArray.from_arrays(pa.array(np.arange(len(grams) + 1, dtype=np.int32) * n), pa.array(grams.ravel()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([kind] * len(grams)), pa.array(np.full(len(grams), n, np.int32)), arr, pa.array(occ.astype(np.int64)), pa.array(recs.astype(np.int64))],
                            names=["item_kind", "n", "gram", "occurrences", "records"],
                        )

    local = data.mapInArrow(count, "item_kind string, n int, gram array<bigint>, occurrences bigint, records bigint")
    if max_n == 1:  # a plain long groups in codegen, an array does not
        local = local.select("item_kind", "n", F.col("gram")[0].alias("item"), "occurrences", "records")
        total = local.groupBy("item_kind", "n", "item").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        return total.select("item_kind", "n", F.array("item").alias("gram"), "occurrences", "records")
    return local.groupBy("item_kind", "n", "gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(counts: DataFrame, n_records: DataFrame, rare_below: int = 3, common_above: float = 0.05) -> DataFrame:
    """``item_kind, item, occurrences, records, mark`` of single items; mark is null for useful ones.

    ``n_records`` is one row with the number of all records in ``n``.
    """
    c = counts.filter("n = 1").select("item_kind", F.col("gram")[0].alias("item"), "occurrences", "records")
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.col("n") * common_above, "common")
    return c.join(F.broadcast(n_records.select("n")), how="cross").withColumn("mark", mark).drop("n")  # one row
