import os
import random

import pytest
from pyspark.sql import functions as F

from thicket.llm import spans
from thicket.llm.mixing import draw_mixture
from thicket.llm.spans import FingerprintIndex, shared_spans, span_coverage, span_pairs, verify_spans, winnow
from thicket.llm.tokenizer import PATTERN, default_vocabulary, decoded, encode_documents, merge_piece, parse_ranks, token_counts, token_ids


@pytest.fixture(scope="module")
def ranks():
    if not os.path.exists(default_vocabulary()):
        pytest.skip("no vocabulary file here")
    return parse_ranks(open(default_vocabulary(), "rb").read())


def texts():
    rng = random.Random(3)
    out = ["", " ", "\n\n1\n", "it's <|endoftext|> they'LL", "x" * 5000, "日本語" * 700, "   a", "🙂" * 50, "\r\n\t \r\n"]
    return out + ["".join(rng.choice("ab's  \n\tthellé世x1٣🙂<|end>.,- 　\r") for _ in range(rng.randrange(60))) for _ in range(300)]


def test_ids_equal_the_public_encoder(spark, ranks):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = list(enumerate(texts() + [None]))
    df = spark.createDataFrame([(i, t, [1]) for i, t in docs], "doc_id long, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in encode_documents(df).collect()}
    assert got == {i: None if t is None else enc.encode_ordinary(t) for i, t in docs}
    n = {r["doc_id"]: r["n"] for r in df.select("doc_id", token_counts(spark, F.col("text")).alias("n")).collect()}
    assert n == {i: len(got[i] or []) for i in got}


def test_decode_round_trip_and_empty(spark, ranks):
    df = spark.createDataFrame([(t,) for t in texts() + [None]], "text string").withColumn("ids", token_ids(spark, F.col("text")))
    assert df.filter(~F.col("text").eqNullSafe(decoded(spark, F.col("ids")))).count() == 0
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merge_of_a_very_long_piece(ranks):
    ids = merge_piece(b"a" * 200_000, ranks)
    assert b"".join({i: s for s, i in ranks.items()}[x] for x in set(ids))
    assert sum(len({i: s for s, i in ranks.items()}[x]) for x in ids[:100]) > 0 and len(ids) < 200_000


def test_mixture(spark):
    rng = random.Random(4)
    rows = [(i, "big" if i % 3 else rng.choice(["small", "tiny", "other", None]), rng.choice([0, None, 5, 10, 40]), rng.choice([0.5, 1.0, None, 0.0])) for i in range(3000)]
    sized = spark.createDataFrame(rows, "id long, source string, size long, weight double").repartition(6)
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("tiny", 0.05, 1), ("absent", 0.05, 4), ("null", None, None)], "source string, target_share double, max_repeats int")
    draw, report = draw_mixture(sized, targets)
    total = sum(s or 0 for _, _, s, _ in rows)
    have, docs = {}, {r["id"]: r for r in draw.collect()}
    for i, src, s, _ in rows:
        have[src] = have.get(src, 0) + (s or 0)
    cap = {"big": 1, "small": 3, "tiny": 1}
    assert all(1 <= r["times"] <= cap[r["source"]] for r in docs.values())
    rep = {r["source"]: r for r in report.collect()}
    for src, share in (("big", 0.6), ("small", 0.3), ("tiny", 0.05)):
        want = min(share * total, have[src] * cap[src])
        taken = sum(r["size"] * r["times"] for r in docs.values() if r["source"] == src)
        assert rep[src]["taken"] == taken and abs(taken - want) <= 20
        times = {i: docs[i]["times"] if i in docs else 0 for i, s2, s, _ in rows if s2 == src and s}
        assert max(times.values()) - min(times.values()) <= 1  # complete epochs come first
    assert rep["absent"]["taken"] == 0 and rep["null"]["taken"] == 0
    assert abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-9
    again = {r["id"]: r["times"] for r in draw_mixture(sized.repartition(2), targets)[0].collect()}
    assert again == {i: r["times"] for i, r in docs.items()}
    d, r = draw_mixture(sized.limit(0), targets)
    assert d.count() == 0 and r.agg(F.sum("taken")).first()[0] == 0


def test_heavier_records_are_drawn_more_often(spark):
    sized = spark.range(4000).select("id", F.lit("a").alias("source"), F.lit(10).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("weight"))
    draw, _ = draw_mixture(sized, spark.createDataFrame([("a", 0.25, 1)], "source string, target_share double, max_repeats int"))
    heavy = draw.filter("id % 2 = 0").count()
    assert draw.count() == 1000 and heavy > 700


def _brute(docs, n):
    seen = {}
    for i, t in docs:
        for j in range(len(t or "") - n + 1):
            seen.setdefault(t[j : j + n], set()).add(i)
    pairs = {(a, b) for s in seen.values() for a in s for b in s if a < b}
    cover = {}
    for i, t in docs:
        hit = [False] * len(t or "")
        for j in range(len(t or "") - n + 1):
            if len(seen[t[j : j + n]]) > 1:
                hit[j : j + n] = [True] * n
        cover[i] = (len(t or ""), sum(hit))
    return pairs, cover


def _docs(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé世🙂 \n") for _ in range(n))
    shared = [word(rng.choice([18, 19, 20, 21, 45])) for _ in range(12)]
    docs = [(i, word(rng.randrange(40)) + "".join(rng.choice(shared) + word(rng.randrange(6)) for _ in range(rng.randrange(4)))) for i in range(60)]
    hot = word(17)  # shorter than the stretch, in front of many documents
    docs += [(100 + i, hot + word(30)) for i in range(40)] + [(200 + i, hot + shared[4]) for i in range(12)]
    return docs + [(300, None), (301, ""), (302, "a" * 90), (303, "b" + "a" * 70), (304, "x"), (305, docs[0][1]), (306, docs[0][1])] + [(i, "copied " * 6 + shared[4]) for i in range(400, 430)]


@pytest.mark.parametrize("few", [32, 1])
def test_spans_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(spans, "FEW", few)
    docs = _docs(few)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, h int, pos int")
    found = shared_spans(df, length=20, gram=8, batches=3)
    pairs, cover = _brute(docs, 20)
    assert {(r["doc_id_a"], r["doc_id_b"]) for r in span_pairs(*found, length=20, gram=8).collect()} == pairs
    assert {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in span_coverage(df, *found, length=20, gram=8).collect()} == cover


def test_index_is_incremental_and_compacts(spark, tmp_path):
    """Every batch comes from an index opened anew on the folder, as in separate jobs."""
    docs = [(i, t) for i, t in _docs(9) if t]
    got = set()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for k in range(4):
        with FingerprintIndex(spark, length=20, gram=8, fanout=2, path=str(tmp_path / "index")) as index:
            hits = index.add(df.filter(F.col("doc_id") % 4 == k))
            runs = list(index.runs)
        upto = df.filter(F.col("doc_id") % 4 <= k)
        got |= {(r["doc_id_a"], r["doc_id_b"]) for r in span_pairs(*verify_spans(hits, upto, 20, 8), length=20, gram=8).collect()}
    assert len(runs) == 1 and runs[0][0] == 2
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["manifest-4", runs[0][2].rsplit("/", 1)[1]]
    assert got == _brute(docs, 20)[0]
    with pytest.raises(ValueError):
        FingerprintIndex(spark, length=30, gram=8, path=str(tmp_path / "index"))
    own = FingerprintIndex(spark, length=20, gram=8)
    own.add(df)
    own.close()
    assert not any(t.name.startswith("thicket_run") for t in spark.catalog.listTables())


def test_winnowing_keeps_a_window_of_every_stretch():
    rng = random.Random(1)
    t = "".join(rng.choice("ab") for _ in range(400))
    pos, _ = winnow(t, 8, 13)
    assert all(any(s <= p <= s + 12 for p in pos) for s in range(400 - 20 + 1))


def test_spans_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    found = shared_spans(df)
    assert span_pairs(*found).count() == 0 and span_coverage(df, *found).count() == 0
