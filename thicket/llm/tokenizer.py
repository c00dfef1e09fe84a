"""Byte-level BPE with the vocabulary of a public tokenizer.

Text is cut into pieces by the vocabulary's pattern.  A piece starts as its bytes,
doubly linked; a priority queue holds the rank of every neighbouring pair that is
in the vocabulary, the lowest rank is merged first and its new neighbours are
pushed, and entries whose symbols have changed since are skipped when popped.
Pieces repeat, so each worker keeps the ids of those it has merged.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Fixed value of this vocabulary: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

KEEP = 500_000  # pieces that a worker remembers at most; only speed depends on it
LONG = 64  # longer pieces are merged but not remembered


def default_vocabulary() -> str:
    return os.path.join("/opt/tokenizers", "byte_bpe_50k.tiktoken")


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by the merge queue."""
    from heapq import heapify, heappop, heappush

    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    end = list(range(1, n + 1))  # symbol that starts at i covers piece[i:end[i]]
    prev, alive = list(range(-1, n - 1)), bytearray(b"\1") * n
    get = ranks.get
    queue = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(queue)
    while queue:
        _, i, j, e = heappop(queue)
        if not alive[i] or end[i] != j or j >= n or not alive[j] or end[j] != e:
            continue  # stale: one of the two symbols has been merged since
        alive[j], end[i] = 0, e
        if e < n:
            prev[e] = i
            if (r := get(piece[i : end[e]])) is not None:
                heappush(queue, (r, i, e, end[e]))
        if (p := prev[i]) >= 0 and (r := get(piece[p:e])) is not None:
            heappush(queue, (r, p, i, e))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class _Pieces(dict):
    """Piece -> its ids as little-endian int32 bytes."""

    def __init__(self, ranks):
        import regex

        super().__init__()
        self.ranks, self.pattern = ranks, regex.compile(PATTERN)

    def __missing__(self, piece):
        from array import array

        got = array("i", merge_piece(piece.encode("utf-8", "replace"), self.ranks)).tobytes()
        if len(piece) <= LONG:
            if len(self) >= KEEP:
                self.clear()
            self[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        if len(text) < 1 << 20:
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        return b"".join(self[m[0]] for m in self.pattern.finditer(text))


def _worker(data) -> _Pieces:
    """The encoder of this Python worker, kept between its tasks."""
    import sys
    import types

    kept = sys.modules.setdefault("_thicket_worker", types.ModuleType("_thicket_worker"))
    if getattr(kept, "tokenizer_id", None) != data.id:
        kept.tokenizer, kept.tokenizer_id = _Pieces(parse_ranks(data.value)), data.id
    return kept.tokenizer


class _Shared:
    """The vocabulary file (a fixed 1 MB) sent to every executor once."""

    def __init__(self, broadcast, ident):
        self.broadcast, self.id = broadcast, ident

    @property
    def value(self):
        return self.broadcast.value


def _share(spark: SparkSession, path: str | None) -> _Shared:
    with open(path or default_vocabulary(), "rb") as f:
        return _Shared(spark.sparkContext.broadcast(f.read()), path or default_vocabulary())


def token_ids(spark: SparkSession, text: Column, vocabulary: str | None = None) -> Column:
    """array<int> of a text column: empty text an empty array, null stays null.

    Strings that look like special tokens are ordinary text.  ``vocabulary`` is the
    path of a rank file on the driver.
    """
    data = _share(spark, vocabulary)

    @arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        import numpy as np

        encode = _worker(data).encode
        got = [None if t is None else encode(t) for t in texts.to_pylist()]
        offsets = np.zeros(len(got) + 1, np.int64)
        np.cumsum([0 if x is None else len(x) >> 2 for x in got], out=offsets[1:])
        values = pa.array(np.frombuffer(b"".join(x for x in got if x), np.int32), pa.int32())
        mask = pa.array([x is None for x in got], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, type=pa.list_(pa.int32()), mask=mask)

    return ids(text)


def token_counts(spark: SparkSession, text: Column, vocabulary: str | None = None) -> Column:
    """Number of ids of a text column as long; 0 for empty and for null texts."""
    data = _share(spark, vocabulary)

    @arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        encode = _worker(data).encode
        return pa.array([0 if not t else len(encode(t)) >> 2 for t in texts.to_pylist()], pa.int64())

    return count(text)


def decoded(spark: SparkSession, ids: Column, vocabulary: str | None = None) -> Column:
    """The text of an array of ids: their vocabulary strings put together; null stays null."""
    data = _share(spark, vocabulary)

    @arrow_udf("string")
    def text(rows: pa.Array) -> pa.Array:
        w = _worker(data)
        if not hasattr(w, "strings"):
            w.strings = {i: s for s, i in w.ranks.items()}
        return pa.array([None if r is None else b"".join(map(w.strings.__getitem__, r)).decode("utf-8", "replace") for r in rows.to_pylist()], pa.string())

    return text(ids)


def encode_documents(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every row; other columns are not read."""
    d = documents.select("doc_id", "text")
    return d.select("doc_id", token_ids(d.sparkSession, F.col("text"), vocabulary).alias("ids"))
