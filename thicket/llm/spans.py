"""Long stretches that occur verbatim in more than one record.

``FingerprintIndex`` is log-structured.  A batch of documents becomes one immutable
run: hashes of ``GRAM``-character windows, thinned by winnowing (the smallest of
every ``length - GRAM + 1`` neighbours), in a table bucketed and sorted by hash.  A
stretch of ``length`` characters always keeps at least one of its windows in every
document that has it, so no shared stretch is missed.  A new run is merge-joined
with itself and the historical runs, bucket by bucket and without a shuffle of the
history; runs of one level are compacted into one of the next when enough of them
have gathered.

Hash hits are then verified on the texts.  Each occurrence of a repeated window is
cut out with up to ``length - GRAM`` characters on both sides; equal cut-outs form a
class, and two classes share a stretch exactly when their common left and right
ends make up the missing characters.  Windows with few classes are compared class
by class; for the others every window of ``length`` characters around the hit is
grouped by its text, which costs a fixed number of rows a class and meets no
pair that isn't real.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.stages import delete_path, list_path, path_exists, stage_path, write_stage

GRAM = 100
FEW = 32  # classes of one window that are compared directly; more are grouped by text


def _window_hashes(cp, width):
    """Polynomial hashes (mod 2**64) of all ``width``-long windows of mixed code points, by doubling."""
    import numpy as np

    x = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    have, base, power = 1, 0xD1342543DE82EF95, x
    out, done = None, 0
    n = len(cp) - width + 1
    rest = width
    while rest:
        if rest & 1:
            piece = power[done : done + n]
            out = piece.copy() if out is None else out * np.uint64(base) + piece
            done += have
        rest >>= 1
        if rest:
            power = power[:-have] * np.uint64(base) + power[have:]
            base = base * base % (1 << 64)
            have *= 2
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def _slide(x, width, f):
    """Minimum or maximum ``f`` of all ``width``-long windows of ``x``."""
    have, cur = 1, x
    while have * 2 <= width:
        cur = f(cur[:-have], cur[have:])
        have *= 2
    if have < width:
        cur = f(cur[: len(cur) - (width - have)], cur[width - have :])
    return cur


def winnow(text: str, gram: int, window: int):
    """``(positions, hashes)`` of the windows kept; all windows if there are fewer than ``window``."""
    import numpy as np

    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = _window_hashes(cp, gram)
    w = min(window, len(h))
    low = _slide(h, w, np.minimum)
    # position i is kept if it is the minimum of some window that covers it
    pad = np.zeros(w - 1, np.uint64)
    high = _slide(np.concatenate([pad, low, pad]), w, np.maximum)
    pos = np.flatnonzero(high == h)
    return pos, h[pos].view(np.int64)


class FingerprintIndex:
    """Sorted immutable runs of window hashes in the shared folder, compacted level by level.

    With a ``path`` the index outlives the session: after every batch a new manifest
    names the runs that count, and a later index on the same path goes on from it.  A
    job that dies between leaves the last manifest and its runs whole; the same batch
    can be added again.  Without a path the runs are the index's own and end with it.
    """

    def __init__(self, spark: SparkSession, length: int = 200, gram: int = GRAM, fanout: int = 4, buckets: int | None = None, path: str | None = None):
        if not 0 < gram < length:
            raise ValueError("gram must be shorter than length")
        self.spark, self.length, self.gram, self.fanout, self.path = spark, length, gram, fanout, path and path.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str, str]] = []  # level, table, path
        self.version = 0
        if self.path:
            self._reopen()

    def __enter__(self) -> FingerprintIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _reopen(self) -> None:
        done = [p for p in list_path(self.spark, self.path) if "/manifest-" in p and path_exists(self.spark, f"{p}/_SUCCESS")]
        self.version = max((int(p.rsplit("-", 1)[1]) for p in done), default=0)
        if not self.version:
            return
        m = json.loads(self.spark.read.text(f"{self.path}/manifest-{self.version}").first()[0])
        if (m["length"], m["gram"]) != (self.length, self.gram):
            raise ValueError(f"the index was built for stretches of {m['length']} and windows of {m['gram']} characters")
        self.buckets = m["buckets"]
        for level, name in m["runs"]:
            table, path = f"thicket_run_{uuid.uuid4().hex}", f"{self.path}/{name}"
            self.spark.sql(f"CREATE TABLE {table} (h BIGINT, doc_id BIGINT, pos INT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{path}'")
            self.runs.append((level, table, path))

    def _commit(self, replaced: list) -> None:
        """Name the runs that count; what they replace goes only then."""
        if self.path:
            m = {"length": self.length, "gram": self.gram, "buckets": self.buckets, "runs": [(r[0], r[2].rsplit("/", 1)[1]) for r in self.runs]}
            self.version += 1
            self.spark.createDataFrame([(json.dumps(m),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.version}")
            delete_path(self.spark, f"{self.path}/manifest-{self.version - 1}")
        for r in replaced:
            self._drop(r)

    def _write_run(self, hashes: DataFrame, level: int) -> tuple[int, str, str]:
        name = f"thicket_run_{uuid.uuid4().hex}"
        path = f"{self.path}/{name}" if self.path else stage_path(self.spark, "run")
        parts = hashes.repartition(self.buckets, "h").sortWithinPartitions("h")
        parts.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).option("compression", "zstd").saveAsTable(name)
        return level, name, path

    def _drop(self, run) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[1]}")
        delete_path(self.spark, run[2])

    def add(self, documents: DataFrame) -> DataFrame:
        """Index ``documents(doc_id, text)``; returns the hits ``(h, doc_id, pos)`` this batch brings.

        A hit is an occurrence, new or historical, of a window that the batch has and
        that at least two documents have.  Null ids and texts shorter than ``length``
        cannot share a stretch.
        """
        gram, window, length = self.gram, self.length - self.gram + 1, self.length

        def fingerprints(batches):
            import numpy as np

            for b in batches:
                docs, poss, hashes = [], [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    pos, h = winnow(t, gram, window)
                    docs.append(np.full(len(pos), i, np.int64))
                    poss.append(pos.astype(np.int32))
                    hashes.append(h)
                if docs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, docs, poss)], names=["h", "doc_id", "pos"])

        long = documents.select(F.col("doc_id").cast("long"), "text").filter((F.length("text") >= length) & F.col("doc_id").isNotNull())
        new = self._write_run(long.mapInArrow(fingerprints, "h bigint, doc_id bigint, pos int"), 0)
        fresh = self.spark.table(new[1])
        span = lambda t: t.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        mine = span(fresh)
        for k, (_, table, _) in enumerate(self.runs):
            old = span(self.spark.table(table)).select("h", F.col("lo").alias(f"lo{k}"), F.col("hi").alias(f"hi{k}"))
            mine = mine.join(old, "h", "left")
        olds = range(len(self.runs))
        lo, hi = (F.least("lo", *[f"lo{k}" for k in olds]), F.greatest("hi", *[f"hi{k}" for k in olds])) if self.runs else (F.col("lo"), F.col("hi"))
        shared = mine.filter(lo < hi).select("h")
        hits = None
        for table in [new[1], *[t for _, t, _ in self.runs]]:
            part = self.spark.table(table).join(shared.hint("merge"), "h")
            hits = part if hits is None else hits.unionByName(part)
        hits = write_stage(hits, "hits")
        self.runs.append(new)
        self._commit(self._compact())
        return hits

    def _compact(self) -> list:
        """Merge full levels; returns the runs that are replaced."""
        old = []
        for level in range(len(self.runs) + 1):
            same = [r for r in self.runs if r[0] == level]
            if len(same) < self.fanout:
                continue
            union = self.spark.table(same[0][1])
            for r in same[1:]:
                union = union.unionByName(self.spark.table(r[1]))
            self.runs = [r for r in self.runs if r[0] != level] + [self._write_run(union, level + 1)]
            old += same
        return old

    def close(self) -> None:
        """Forget the tables; runs without a path are deleted."""
        for r in self.runs:
            if self.path:
                self.spark.sql(f"DROP TABLE IF EXISTS {r[1]}")
            else:
                self._drop(r)
        self.runs = []


def _cut_outs(hits: DataFrame, documents: DataFrame, length: int, gram: int) -> DataFrame:
    """Hits with the text around them: ``h, doc_id, pos, l, g, r``."""
    side = length - gram
    by_doc = hits.groupBy("doc_id").agg(F.collect_set(F.struct("h", "pos")).alias("at"))
    docs = documents.select(F.col("doc_id").cast("long"), "text").filter((F.length("text") >= length) & F.col("doc_id").isNotNull())
    # SQL's substring would scan a text from its start for each hit; one pass over it does not
    cut = docs.join(by_doc, "doc_id")

    def cutting(batches):
        import numpy as np

        for b in batches:
            ids, hs, poss, ls, gs, rs = [], [], [], [], [], []
            for i, t, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for e in at:
                    p = e["pos"]
                    ids.append(i), hs.append(e["h"]), poss.append(p)
                    ls.append(t[max(0, p - side) : p]), gs.append(t[p : p + gram]), rs.append(t[p + gram : p + length])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(hs, np.int64)), pa.array(np.array(ids, np.int64)), pa.array(np.array(poss, np.int32)), pa.array(ls, pa.string()), pa.array(gs, pa.string()), pa.array(rs, pa.string())], names=["h", "doc_id", "pos", "l", "g", "r"])

    return cut.select("doc_id", "text", "at").mapInArrow(cutting, "h bigint, doc_id bigint, pos int, l string, g string, r string")


def verify_spans(hits: DataFrame, documents: DataFrame, length: int = 200, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``hits(h, doc_id, pos)`` -> ``(members, links, wide)``, all checked on the text.

    ``members(cls, doc_id, pos, left, right)``: occurrences with equal cut-outs have
    one ``cls``; ``left`` and ``right`` are the characters cut out beside the window.
    ``links(cls_a, cls_b, left, right)``: two classes sharing at least ``length``
    characters around the window.  ``wide(win, cls, off)``: classes of crowded windows
    by the exact ``length``-character stretch they hold, which starts ``off``
    characters before the window; those of equal ``win`` are linked.
    """
    side = length - gram
    occ = write_stage(_cut_outs(hits, documents, length, gram), "cutouts")
    cut = ["h", "l", "g", "r"]
    cls = write_stage(
        occ.groupBy(*cut).agg(F.min(F.struct("doc_id", "pos")).alias("rep"), F.count(F.lit(1)).alias("n")).select(
            F.concat_ws(":", "rep.doc_id", "rep.pos").alias("cls"), *cut, "n"),
        "cutclasses",
    )
    members = occ.join(cls.select("cls", *cut), cut).select("cls", "doc_id", "pos", F.length("l").alias("left"), F.length("r").alias("right"))
    crowd = cls.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    sized = cls.join(crowd, "h")
    few = sized.filter(F.col("k") <= FEW).groupBy("h").agg(F.collect_list(F.struct("cls", "l", "g", "r")).alias("of"))

    def compare(batches):
        def common(a, b):
            if a == b:
                return len(a)
            lo, hi = 0, min(len(a), len(b))
            while lo < hi:
                m = (lo + hi + 1) // 2
                if a[:m] == b[:m]:
                    lo = m
                else:
                    hi = m - 1
            return lo

        for b in batches:
            out = ([], [], [], [])
            for of in b.column(0).to_pylist():
                of = [(e["cls"], e["l"][::-1], e["g"], e["r"]) for e in of]
                for i, x in enumerate(of):
                    for y in of[:i]:
                        if x[2] == y[2]:
                            left, right = common(x[1], y[1]), common(x[3], y[3])
                            if left + right >= side:
                                for o, v in zip(out, (x[0], y[0], left, right)):
                                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["cls_a", "cls_b", "left", "right"])

    links = few.select("of").mapInArrow(compare, "cls_a string, cls_b string, left int, right int")
    many = sized.filter(F.col("k") > FEW).withColumn("t", F.concat("l", "g", "r"))
    starts = many.filter(F.length("t") >= length).select("cls", "t", F.length("l").alias("left"), F.explode(F.sequence(F.lit(0), F.length("t") - length)).alias("s"))
    wide = starts.select(F.substring("t", F.col("s") + 1, F.lit(length)).alias("win"), "cls", (F.col("left") - F.col("s")).alias("off"))
    return members, links, wide


def exact_copies(documents: DataFrame, length: int = 200) -> DataFrame:
    """``doc_id, rep``: documents whose text a smaller id has too (equal SHA-256), from ``length`` characters on."""
    keyed = documents.select(F.col("doc_id").cast("long"), "text").filter((F.length("text") >= length) & F.col("doc_id").isNotNull()).select("doc_id", F.sha2("text", 256).alias("k"))
    groups = keyed.groupBy("k").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(groups.select("k", "rep"), "k").filter("doc_id <> rep").select("doc_id", "rep")


def shared_spans(documents: DataFrame, length: int = 200, gram: int = GRAM, batches: int = 3, fanout: int = 2):
    """Index ``documents`` in ``batches`` parts (by a hash of their id) and verify all hits.

    Each part meets the runs before it; every ``fanout`` runs of a level are compacted.

    Returns the three relations of ``verify_spans`` over one document of each group of
    exact copies, and ``copies(doc_id, rep)``: a group of any size is verified once.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text")
    hits = None
    with FingerprintIndex(spark, length, gram, fanout) as index:
        for k in range(batches):
            got = index.add(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
            hits = got if hits is None else hits.unionByName(got)
    copies = write_stage(exact_copies(docs, length), "copies")
    single = hits.join(copies.select("doc_id"), "doc_id", "left_anti")
    still = single.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    return *verify_spans(single.join(still.select("h"), "h", "left_semi"), docs, length, gram), copies


def _copy_groups(copies: DataFrame) -> DataFrame:
    """``rep, doc_id`` with each representative among its own members."""
    return copies.select("rep", "doc_id").unionByName(copies.select("rep", F.col("rep").alias("doc_id")).distinct())


def span_pairs(members: DataFrame, links: DataFrame, wide: DataFrame, copies: DataFrame | None = None, length: int = 200, gram: int = GRAM) -> DataFrame:
    """All pairs ``doc_id_a < doc_id_b`` of documents with a shared stretch."""
    one = members.select("cls", "doc_id").distinct()
    whole = members.filter(F.col("left") + F.col("right") >= length - gram).select("cls", "doc_id").distinct()
    inside = whole.select("cls", F.col("doc_id").alias("x")).join(whole, "cls").select("x", F.col("doc_id").alias("y")).filter("x < y")
    across = (
        links.select("cls_a", "cls_b").distinct()
        .join(one.select(F.col("cls").alias("cls_a"), F.col("doc_id").alias("x")), "cls_a")
        .join(one.select(F.col("cls").alias("cls_b"), F.col("doc_id").alias("y")), "cls_b")
        .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).filter("x < y")
    )
    held = wide.select("win", "cls").join(one, "cls").select("win", "doc_id").distinct()
    grouped = held.select("win", F.col("doc_id").alias("x")).join(held, "win").select("x", F.col("doc_id").alias("y")).filter("x < y")
    pairs = inside.unionByName(across).unionByName(grouped).distinct()
    if copies is not None:
        group = _copy_groups(copies)
        a, b = group.select(F.col("rep").alias("x"), F.col("doc_id").alias("_x")), group.select(F.col("rep").alias("y"), F.col("doc_id").alias("_y"))
        spread = pairs.join(a, "x", "left").join(b, "y", "left").select(F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y"))
        own = a.join(group, F.col("x") == F.col("rep")).filter(F.col("_x") < F.col("doc_id")).select(F.col("_x").alias("x"), F.col("doc_id").alias("y"))
        pairs = spread.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).unionByName(own)
    return pairs.select(F.col("x").alias("doc_id_a"), F.col("y").alias("doc_id_b"))


def span_coverage(documents: DataFrame, members: DataFrame, links: DataFrame, wide: DataFrame, copies: DataFrame | None = None, length: int = 200, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_chars, shared_chars`` of every document; null and short texts share nothing.

    Works on classes: each gets the widest stretch verified for it, every member
    carries that over to its own position, and overlapping intervals are merged.
    """
    plural = members.groupBy("cls").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("left").alias("left"), F.max("right").alias("right"))
    own = plural.filter((F.col("lo") < F.col("hi")) & (F.col("left") + F.col("right") >= length - gram)).select("cls", F.col("left").alias("a"), (F.col("right") + gram).alias("z"))
    ends = plural.select("cls", "lo", "hi")
    real = links.join(ends.select(F.col("cls").alias("cls_a"), F.col("lo").alias("la"), F.col("hi").alias("ha")), "cls_a").join(
        ends.select(F.col("cls").alias("cls_b"), F.col("lo").alias("lb"), F.col("hi").alias("hb")), "cls_b").filter(F.least("la", "lb") < F.greatest("ha", "hb"))
    far = real.select(F.explode(F.array("cls_a", "cls_b")).alias("cls"), F.col("left").alias("a"), (F.col("right") + gram).alias("z"))
    many = wide.join(ends, "cls")
    good = many.groupBy("win").agg(F.min("lo").alias("l0"), F.max("hi").alias("h0")).filter("l0 < h0").select("win")
    crowded = wide.join(good, "win", "left_semi").select("cls", F.col("off").alias("a"), (F.lit(length) - F.col("off")).alias("z"))
    spans = own.unionByName(far).unionByName(crowded).distinct()
    at = members.select("cls", "doc_id", "pos").join(spans, "cls").select("doc_id", (F.col("pos") - F.col("a")).alias("s"), (F.col("pos") + F.col("z")).alias("e")).distinct()
    w = Window.partitionBy("doc_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = at.withColumn("before", F.coalesce(F.max("e").over(w), F.lit(0)))
    shared = fresh.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "before"))).alias("shared_chars"))
    every = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    if copies is not None:  # a copy is shared as a whole
        whole = _copy_groups(copies).select("doc_id", F.lit(True).alias("_copy"))
        every = every.join(whole, "doc_id", "left")
    else:
        every = every.withColumn("_copy", F.lit(None).cast("boolean"))
    chars = F.when(F.col("_copy"), F.col("n_chars")).otherwise(F.coalesce("shared_chars", F.lit(0)))
    return every.join(shared, "doc_id", "left").select("doc_id", "n_chars", chars.alias("shared_chars"))
