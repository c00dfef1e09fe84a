"""Clusters of mutually similar records by density peaks.

Blocked neighbour joins: a vector's signed anchors are put into one order, rare ones
first, and its prefix is cut where what follows is too short for a cosine of at least
the threshold.  Two similar vectors then share an anchor of their prefixes, and meet
in its block.  Crowded blocks are cut into tiles of bounded size.  Within tiles the
products of common anchors are summed per pair, or, where a tile is dense, taken as
one matrix product; a pair counts in the first block that it shares.

One pass gives each point's number of neighbours (its local density), its nearest
neighbours and the tile's connections.  Most points have a denser one among their
nearest neighbours, which then is the nearest denser one; only for the others is the
search repeated, against the points denser than they are.  Points without one inside
the radius are peaks; all others follow their pointers uphill to a peak.  Peaks whose
basins touch, that is, hold a similar pair, are one cluster, as clusters are defined
by connection.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import connected_components, resolve_pointers
from ..plans.ranking import top_positions
from ..plans.stages import drop_stage, write_stage

TILE = 1024
NEAR = 8  # nearest neighbours kept from the first pass
DENSE = 2_000_000  # products of one tile from which it is multiplied as a matrix
LOW = (1 << 33) - 1  # an ordered token is its count << 33 | anchor << 1 | sign


def _vectors(points: DataFrame) -> DataFrame:
    """``p, tok, val``: unit vectors without zeros, sorted by signed anchor."""

    def normal(batches):
        for b in batches:
            arr = b.column(1)
            width = arr.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = arr.flatten()
            idx = flat.field("idx").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            good = flat.is_valid().to_numpy(zero_copy_only=False) & flat.field("idx").is_valid().to_numpy(zero_copy_only=False)
            val = np.where(good, flat.field("val").fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)
            row = np.repeat(np.arange(len(width)), width)
            ok = np.isfinite(val) & (val != 0)
            idx, val, row = idx[ok], val[ok], row[ok]
            o = np.lexsort((val, idx, row))  # of a repeated anchor the largest value counts
            idx, val, row = idx[o], val[o], row[o]
            last = np.r_[(idx[1:] != idx[:-1]) | (row[1:] != row[:-1]), np.ones(min(1, len(row)), bool)]
            idx, val, row = idx[last], val[last], row[last]
            top = np.zeros(len(width))
            np.maximum.at(top, row, np.abs(val))
            val = val / top[row]
            val = val / np.sqrt(np.bincount(row, val * val, len(width)))[row]
            size = np.bincount(row, minlength=len(width))
            have = np.flatnonzero(size)
            ends = pa.array(np.r_[0, np.cumsum(size[have])].astype(np.int32))
            tok = pa.ListArray.from_arrays(ends, pa.array((idx & 0xFFFFFFFF) * 2 + (val > 0)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(have)), tok, pa.ListArray.from_arrays(ends, pa.array(val))], names=["p", "tok", "val"])

    return points.mapInArrow(normal, "p bigint, tok array<bigint>, val array<double>")


def _ordered(classes: DataFrame, threshold: float) -> DataFrame:
    """``p, n, tok, val, plen`` with tokens in order, rare ones first, and the length of the prefix."""
    cells = classes.select("p", "n", F.explode(F.arrays_zip("tok", "val")).alias("e")).select("p", "n", F.col("e.tok").alias("tok"), F.col("e.val").alias("val"))
    count = write_stage(cells.groupBy("tok").agg(F.count(F.lit(1)).alias("c")), "anchors")
    key = F.shiftleft("c", 33).bitwiseOR(F.col("tok")).alias("tok")
    v = cells.join(count, "tok").groupBy("p").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct(key, "val"))).alias("f"))
    # what follows the prefix is shorter than the threshold
    enough = 1 - threshold**2 + 1e-9
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"))
    grow = lambda a, e: F.when(a["s"] > enough, a).otherwise(F.struct((a["s"] + e["val"] * e["val"]).alias("s"), (a["k"] + 1).alias("k")))
    return v.select("p", "n", F.col("f.tok").alias("tok"), F.col("f.val").alias("val"), F.aggregate("f", start, grow, lambda a: a["k"]).alias("plen"))


def _blocks(vectors: DataFrame) -> DataFrame:
    """``p, key, sub, ti, tj``: the tiles in which each point takes part."""
    keys = vectors.select("p", F.explode(F.slice("tok", F.lit(1), F.col("plen"))).alias("key"))
    crowd = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("subs"))
    at = keys.join(crowd, "key").withColumn("sub", F.pmod(F.xxhash64("p", "key"), F.col("subs")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("subs") - 1))
    return at.withColumn("o", other).select("p", "key", "sub", F.least("sub", "o").alias("ti"), F.greatest("sub", "o").alias("tj"))


class _Chunk:
    """Rows of whole tiles, sorted by tile and point."""

    def __init__(self, b):
        col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
        plain = lambda n: col[n].to_numpy(zero_copy_only=False)
        self.n, self.p, self.sub, self.weight = b.num_rows, plain("p"), plain("sub"), plain("n")
        self.rho = plain("rho") if "rho" in col else None
        self.open = plain("open") if "open" in col else None
        key, ti, tj = plain("key"), plain("ti"), plain("tj")
        new = np.r_[True, (key[1:] != key[:-1]) | (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])]
        self.start = np.r_[np.flatnonzero(new), self.n]  # of each tile
        self.size = np.diff(self.start)
        self.tile = np.repeat(np.arange(len(self.size)), self.size)
        self.single = (ti == tj)[self.start[:-1]]
        width = col["tok"].value_lengths().to_numpy(zero_copy_only=False)
        tok = col["tok"].flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(self.n), width)
        place = np.arange(len(tok)) - np.repeat(np.cumsum(width) - width, width)
        self.cells = self._grouped(row, (tok & LOW) >> 1, col["val"].flatten().to_numpy(zero_copy_only=False))
        early = (place < plain("plen")[row]) & (tok < key[row])  # shared ones make this not the first common block
        self.early = self._grouped(row[early], tok[early], np.ones(int(early.sum())))

    def _grouped(self, row, name, value):
        """Entries in order of (tile, name, row): rows, names, values, place among equal names, and where each tile starts."""
        o = np.lexsort((row, name, self.tile[row]))
        row, name, value = row[o], name[o], value[o]
        t = self.tile[row]
        new = np.r_[np.ones(min(1, len(row)), bool), (t[1:] != t[:-1]) | (name[1:] != name[:-1])]
        begin = np.flatnonzero(new)
        place = np.arange(len(row)) - np.repeat(begin, np.diff(np.r_[begin, len(row)]))
        return row, name, value, place, np.searchsorted(t, np.arange(len(self.size) + 1))

    def work(self):
        """Products that each tile costs."""
        t = self.tile[self.cells[0]]
        return np.bincount(t, self.cells[3], len(self.size)).astype(np.int64)

    def sums(self, cells, lo, hi, base, total):
        """Sums of products of equal names for the pairs (later row, earlier row) of the tiles lo..hi."""
        row, _, value, place, at = cells
        s = slice(at[lo], at[hi])
        row, value, place = row[s], value[s], place[s]
        i = np.repeat(np.arange(len(row)), place)
        j = i - 1 - (np.arange(len(i)) - np.repeat(np.cumsum(place) - place, place))
        t = self.tile[row]
        local = row - self.start[t]
        slot = base[t[i] - lo] + local[i] * self.size[t[i]] + local[j]
        return np.bincount(slot, value[i] * value[j], total)


def _sparse_tiles(c: _Chunk, tiles, threshold: float):
    """Similar pairs ``(i, j, cosine)`` of runs of tiles, each pair in its first common block."""
    work = c.work()
    lo = 0
    while lo < len(tiles):
        hi, room, products = lo, 0, 0
        while hi < len(tiles) and (hi == lo or (tiles[hi] == tiles[hi - 1] + 1 and room + c.size[tiles[hi]] ** 2 <= 2_000_000 and products + work[tiles[hi]] <= DENSE)):
            room, products = room + int(c.size[tiles[hi]]) ** 2, products + int(work[tiles[hi]])
            hi += 1
        a, z = int(tiles[lo]), int(tiles[hi - 1]) + 1
        lo = hi
        square = c.size[a:z].astype(np.int64) ** 2
        base = np.cumsum(square) - square
        hit = c.sums(c.cells, a, z, base, room)
        slot = np.flatnonzero(hit >= threshold)
        if not len(slot):
            continue
        slot = slot[c.sums(c.early, a, z, base, room)[slot] == 0]
        t = np.searchsorted(base, slot, "right") - 1 + a
        i, j = divmod(slot - base[t - a], c.size[t])
        i, j = i + c.start[t], j + c.start[t]
        ok = c.single[t] | (c.sub[i] != c.sub[j])
        yield i[ok], j[ok], hit[slot[ok]]


def _dense_tile(c: _Chunk, t: int, threshold: float, only=None):
    """``(left rows, right rows, cosines, mask)`` of one tile by matrix products; ``only`` are the left rows wanted."""
    rows = np.arange(c.start[t], c.start[t + 1])

    def matrix(cells):
        row, name, value, _, at = cells
        s = slice(at[t], at[t + 1])
        _, inv, many = np.unique(name[s], return_inverse=True, return_counts=True)
        slot, ok = np.cumsum(many > 1) - 1, many[inv] > 1
        out = np.zeros((len(rows), max(1, int((many > 1).sum()))))
        out[row[s][ok] - rows[0], slot[inv[ok]]] = value[s][ok]
        return out

    left = rows if only is None else rows[only[rows]]
    if not len(left):
        return None
    x, f = matrix(c.cells), matrix(c.early)
    cos = x[left - rows[0]] @ x.T
    mask = (cos >= threshold) & (f[left - rows[0]] @ f.T == 0)
    mask[np.arange(len(left)), left - rows[0]] = False
    if not c.single[t]:
        mask &= c.sub[left][:, None] != c.sub[rows][None, :]
    return left, rows, cos, mask


def _hook(n: int, i, j):
    """Component labels of rows 0..n-1 joined by the pairs (i, j): the least row of each."""
    label = np.arange(n)
    while len(i):
        m = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, m)
        np.minimum.at(label, j, m)
        label = label[label]
        if (label == before).all():
            break
    return label


def _whole_tiles(batches):
    """Chunks that end at tile borders, whatever the batches do."""
    kept = None
    for b in batches:
        if not b.num_rows:
            continue
        if kept is not None:
            b = pa.Table.from_batches([kept, b]).combine_chunks().to_batches()[0]
        tile = np.stack([b.column(b.schema.names.index(k)).to_numpy(zero_copy_only=False) for k in ("key", "ti", "tj")], 1)
        same = (tile == tile[-1]).all(1)
        cut = b.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield _Chunk(b.slice(0, cut))
        kept = b.slice(cut)
    if kept is not None and kept.num_rows:
        yield _Chunk(kept)


def _tiles(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    key = ["key", "ti", "tj"]
    return blocks.join(vectors, "p").repartition(*key).sortWithinPartitions(*key, "p")


def _nearest(row, cos, other, m: int):
    """Positions of the m nearest of each row: by cosine, then the smaller id."""
    o = np.lexsort((other, -cos, row))
    r = row[o]
    begin = np.flatnonzero(np.r_[np.ones(min(1, len(r)), bool), r[1:] != r[:-1]])
    return o[np.arange(len(r)) - np.repeat(begin, np.diff(np.r_[begin, len(r)])) < m]


_FOUND = "kind int, p bigint, q bigint, v double"


def _neighbours(threshold: float):
    """The first pass.  Kinds: 0 = p has q neighbours of weight v, 1 = q is near p with cosine v, 2 = p and q are connected."""

    def search(batches):
        for c in _whole_tiles(batches):
            near, many, weight = [], np.zeros(c.n, np.int64), np.zeros(c.n)
            dense = c.work() > DENSE
            pairs = list(_sparse_tiles(c, np.flatnonzero(~dense), threshold))
            i, j, cos = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for a, b in ((i, j), (j, i)):
                many += np.bincount(a, minlength=c.n)
                weight += np.bincount(a, c.weight[b], c.n)
                near.append((a, b, cos))
            hooks = [(i, j)]
            for t in np.flatnonzero(dense):
                left, right, cosines, mask = _dense_tile(c, t, threshold)
                many[left] += mask.sum(1)
                weight[left] += mask @ c.weight[right]
                v = np.where(mask, cosines, -2.0)  # columns are in order of id
                best = np.argsort(-v, axis=1, kind="stable")[:, :NEAR]
                value = np.take_along_axis(v, best, 1)
                a, b = np.nonzero(value > -2)
                near.append((left[a], right[best[a, b]], value[a, b]))
                first = mask.argmax(1)  # one edge a row, then rows of equal reach
                label = np.arange(len(left))
                while True:
                    new = np.minimum(label, np.where(mask, label[None, :], len(label)).min(1))
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                some = mask[np.arange(len(left)), first]
                hooks.append((left[some], right[label[some]]))
            row, other, cos = (np.concatenate(x) for x in zip(*near))
            best = _nearest(row, cos, c.p[other], NEAR)
            i, j = (np.concatenate(x) for x in zip(*hooks))
            label = _hook(c.n, i, j)
            at, hooked = np.flatnonzero(many), np.flatnonzero(label != np.arange(c.n))
            cols = [
                np.repeat([0, 1, 2], [len(at), len(best), len(hooked)]).astype(np.int32), np.r_[c.p[at], c.p[row[best]], c.p[hooked]],
                np.r_[many[at], c.p[other[best]], c.p[label[hooked]]], np.r_[weight[at], cos[best], np.zeros(len(hooked))],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["kind", "p", "q", "v"])

    return search


def _denser(threshold: float):
    """The second pass: for each open point the nearest denser neighbour of a tile."""

    def search(batches):
        for c in _whole_tiles(batches):
            dense = c.work() > DENSE
            found = []
            above = lambda a, b: (c.rho[b] > c.rho[a]) | ((c.rho[b] == c.rho[a]) & (c.p[b] < c.p[a]))
            for i, j, cos in _sparse_tiles(c, np.flatnonzero(~dense), threshold):
                for a, b in ((i, j), (j, i)):
                    ok = c.open[a] & above(a, b)
                    found.append((a[ok], b[ok], cos[ok]))
            for t in np.flatnonzero(dense):
                if (got := _dense_tile(c, t, threshold, c.open)) is None:
                    continue
                left, right, cosines, mask = got
                v = np.where(mask & above(left[:, None], right[None, :]), cosines, -2.0)
                k = v.argmax(1)
                ok = v[np.arange(len(left)), k] > -2
                found.append((left[ok], right[k[ok]], v[np.arange(len(left)), k][ok]))
            if found:
                row, other, cos = (np.concatenate(x) for x in zip(*found))
                best = _nearest(c.p[row], cos, c.p[other], 1)
                yield pa.RecordBatch.from_arrays([pa.array(c.p[row[best]]), pa.array(c.p[other[best]]), pa.array(cos[best])], names=["p", "q", "cos"])

    return search


def density_clusters(points: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``point_idx, sim_values`` -> ``point_idx, cluster_idx, density, uphill, cosine, peak``.

    One row per distinct point with a non-zero value that has a neighbour of at
    least ``threshold``; the others are similar to none and left out.  ``density`` is
    the number of neighbours, ``uphill`` the nearest denser one (equal densities: the
    smaller id is denser) with its ``cosine``, null for peaks; ``cluster_idx`` the
    smallest point of the cluster.  Null members and values, NaN and infinite ones
    are 0; of a repeated anchor the largest value counts, of repeated rows the
    greatest array.  Null ids are no points.
    """
    one = points.select(F.col("point_idx").cast("long").alias("p"), F.col("sim_values").cast("array<struct<idx:int,val:double>>").alias("v")).filter("p is not null")
    every = write_stage(_vectors(one.groupBy("p").agg(F.max("v").alias("v"))), "points")
    # points of one direction are a class: its smallest id takes part, with the weight of all
    classes = write_stage(every.groupBy("tok", "val").agg(F.min("p").alias("p"), F.count(F.lit(1)).alias("n")), "classes")
    copies = every.join(classes.filter("n > 1").select("tok", "val", F.col("p").alias("rep")), ["tok", "val"]).filter("p <> rep").select("p", "rep")
    vectors = write_stage(_ordered(classes, threshold), "vectors")
    blocks = write_stage(_blocks(vectors), "blocks")
    found = write_stage(_tiles(blocks, vectors).mapInArrow(_neighbours(threshold), _FOUND), "neighbours")
    near = found.filter("kind = 0").groupBy("p").agg(F.sum("q").alias("many"), F.sum("v").cast("long").alias("near"))
    own = vectors.select("p", (F.col("n") - 1).alias("own")).join(near, "p", "left")
    rho = write_stage(own.select("p", (F.col("own") + F.coalesce("near", F.lit(0))).alias("rho"), F.coalesce("many", F.lit(0)).alias("many")).filter("rho > 0"), "density")

    w = Window.partitionBy("p").orderBy(F.col("v").desc(), "q")
    close = found.filter("kind = 1").select("p", "q", "v", F.row_number().over(w).alias("r")).filter(F.col("r") <= NEAR)  # a tile gives at most NEAR a point
    there = rho.select(F.col("p").alias("q"), F.col("rho").alias("qrho"))
    here = rho.select("p", "rho")
    up = close.join(there, "q").join(here, "p").filter("qrho > rho or (qrho = rho and q < p)")
    pick = F.max(F.struct(F.col("v").alias("cos"), (-F.col("q")).alias("nq"))).alias("b")
    best = up.groupBy("p").agg(pick)
    state = write_stage(rho.join(best, "p", "left").select("p", "rho", (-F.col("b.nq")).alias("uphill"), F.col("b.cos").alias("cosine"), (F.col("b").isNull() & (F.col("many") > NEAR)).alias("open")), "hills")
    far = _tiles(
        blocks.join(blocks.join(state.filter("open").select("p"), "p", "left_semi").select("key", "ti", "tj").distinct(), ["key", "ti", "tj"], "left_semi"),
        vectors.join(state.select("p", "rho", "open"), "p"),
    ).mapInArrow(_denser(threshold), "p bigint, q bigint, cos double")
    rest = far.groupBy("p").agg(F.max(F.struct("cos", (-F.col("q")).alias("nq"))).alias("b"))
    hill = state.join(rest, "p", "left").select("p", "rho", F.coalesce("uphill", -F.col("b.nq")).alias("uphill"), F.coalesce("cosine", "b.cos").alias("cosine"))
    hill = write_stage(hill, "hills")
    for done in (blocks, vectors, state):
        drop_stage(done)
    ends = resolve_pointers(hill.select(F.col("p").alias("node"), F.coalesce("uphill", "p").alias("to")))
    touch = found.filter("kind = 2").select("p", "q").distinct()
    touch = touch.join(ends.select(F.col("node").alias("p"), F.col("end").alias("a")), "p").join(ends.select(F.col("node").alias("q"), F.col("end").alias("b")), "q")
    merged = connected_components(touch.filter("a <> b").select("a", "b"))
    labelled = hill.join(ends.withColumnRenamed("node", "p"), "p").join(merged.withColumnRenamed("node", "end"), "end", "left")
    labelled = write_stage(labelled.select("p", "rho", "uphill", "cosine", "end", F.coalesce("component", "end").alias("c")), "labels")
    least = labelled.groupBy("c").agg(F.min("p").alias("cluster_idx"))
    reps = labelled.join(least, "c").select(F.col("p").alias("point_idx"), "cluster_idx", F.col("rho").alias("density"), "uphill", "cosine", F.col("end").alias("peak"))
    same = copies.join(reps.withColumnRenamed("point_idx", "rep"), "rep").select(
        F.col("p").alias("point_idx"), "cluster_idx", "density", F.col("rep").alias("uphill"), F.lit(1.0).alias("cosine"), "peak")
    return reps.unionByName(same)


def describe_clusters(clusters: DataFrame, typical: int = 3) -> DataFrame:
    """``cluster_idx, size, peaks, typical``: the densest members first, ties by id."""
    size = clusters.groupBy("cluster_idx").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("uphill").isNull().cast("long")).alias("peaks"))
    top = top_positions(clusters.select("cluster_idx", "density", "point_idx"), ["cluster_idx"], [F.col("density").desc(), F.col("point_idx").asc()], typical)
    few = top.groupBy("cluster_idx").agg(F.array_sort(F.collect_list(F.struct("position", "point_idx"))).alias("t"))
    return size.join(few, "cluster_idx").select("cluster_idx", "size", "peaks", F.col("t.point_idx").alias("typical"))
