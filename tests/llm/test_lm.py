import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from reqsight.llm import lm_score
from tests.llm.conftest import edge_rows


def brute(rows):
    split = [(i, (t or "").encode().lower().split()) for i, t in rows]
    uni = Counter(w for _, ws in split for w in ws)
    uni[None] = sum(1 for _, ws in split if ws)
    bi = Counter(p for _, ws in split for p in zip([None, *ws], ws))
    total = sum(n for w, n in uni.items() if w is not None)
    out = {}
    for i, ws in split:
        lp, n = out.get(i, (0.0, 0))
        for c, w in zip([None, *ws], ws):
            lp += math.log(bi[c, w] / uni[c]) if bi[c, w] >= lm_score.MIN_COUNT else math.log(lm_score.ALPHA * uni[w] / total)
        out[i] = lp, n + len(ws)
    return out


@pytest.mark.parametrize("heavy, slices", [(50_000, 1), (3, 3)])
def test_scores(edge, heavy, slices, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAVY_WORDS", heavy)
    got = {r.doc_id: r for r in lm_score.lm_scores(edge, slices=slices).collect()}
    want = brute([r[:2] for r in edge_rows()])
    assert set(got) == set(want)
    for i, (lp, n) in want.items():
        assert got[i].n_words == n and math.isclose(got[i].log_prob, lp, rel_tol=1e-9, abs_tol=1e-9), i
        assert (got[i].score is None) if n == 0 else math.isclose(got[i].score, lp / n, rel_tol=1e-9)


def test_empty(nothing):
    assert lm_score.lm_scores(nothing).count() == 0


def test_hot_bigram_is_dealt_out(spark):
    """One word pair has a third of all rows: it is counted before the shuffle, its rows are dealt out, and no score changes."""
    rows = [(i, f"hot pair w{i} x{i % 7}") for i in range(400)] + [(i, "") for i in range(400, 410)] + [(7, "hot pair hot pair")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r for r in lm_score.lm_scores(docs, slices=2).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, (lp, n) in want.items():
        assert got[i].n_words == n and math.isclose(got[i].log_prob, lp, rel_tol=1e-9, abs_tol=1e-9), i
    texts = docs.selectExpr("doc_id", "text t")
    binned = texts.select("t").mapInArrow(lm_score._count(16 * 256), "w bigint, n bigint, binned boolean").filter("binned")
    hot = lm_score.hot_bigrams(texts, binned.groupBy("w").agg(F.sum("n").alias("n")), 256).collect()
    h = lm_score.word_hashes("hot pair").view("int64").tolist()
    start = lm_score.START
    counts = {(r.c, r.w): (r.hot_n, r.salts) for r in hot}
    assert counts[h[0], h[1]][0] == 402 and counts[start, h[0]][0] == 401 and counts[h[0], h[1]][1] > 60
    assert len(hot) < 256


def test_no_hot_bigram_no_second_pass(spark):
    rows = [(i, " ".join(f"a{i}b{j}" for j in range(50))) for i in range(40)]
    texts = spark.createDataFrame(rows, "doc_id bigint, t string")
    binned = texts.select("t").mapInArrow(lm_score._count(16 * 256), "w bigint, n bigint, binned boolean").filter("binned")
    binned = binned.groupBy("w").agg(F.sum("n").alias("n"))
    assert binned.agg(F.sum("n")).first()[0] == 2000
    few = lm_score.hot_bigrams(texts, binned, 256)
    assert few is None or few.count() == 0


def test_words_are_hashed_many_at_a_time(monkeypatch):
    """Texts of one column side by side: words end with their text, equal words have equal hashes, others have others; no word by word work."""
    calls = []
    monkeypatch.setattr(lm_score, "CHUNK", 40)
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda w, f=xxhash.xxh64_intdigest: calls.append(w) or f(w))
    pieces = ["a", "A", "b", " ", "\n", "\x0b", "\x1c", "\x00", "\u00e9", "\u00c9", "abcdefg", "abcdefgh", "tab\there", "w" * 17]
    texts = [None, "", " ", "x", "x ", " x"] + ["".join(pieces[(i * k + k) % len(pieces)] for k in range(i % 9)) for i in range(300)] + [None, "end"]
    column = pa.array(["cut off", *texts]).slice(1)
    got, seen = [[] for _ in texts], {}
    for first, n, text, h, g in lm_score.chunks(column):
        assert len(text) == len(h) == len(g) == n.sum()
        for i, w in zip(text.tolist(), h.tolist()):
            got[first + i].append(w)
    for t, hashes in zip(texts, got):
        words = (t or "").encode().lower().split()
        assert len(words) == len(hashes) and lm_score.word_hashes(t).tolist() == hashes
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes))
    assert len(set(seen.values())) == len(seen) > 30
    assert calls and min(map(len, calls)) > 16


@pytest.mark.parametrize("frequent, chunk, flush", [(0, 1 << 20, 1 << 22), (2, 64, 100), (100_000, 1 << 20, 1 << 22)])
def test_any_frequent_bigrams_give_the_same_scores(spark, frequent, chunk, flush, monkeypatch):
    for name, value in (("FREQUENT", frequent), ("CHUNK", chunk), ("FLUSH", flush)):
        monkeypatch.setattr(lm_score, name, value)
    rows = [(i, " ".join(f"a{i % 3} b{j % 5} c{i * j % 11}" for j in range(i % 6))) for i in range(60)] + [(None, "b1 c1 b1 c1"), (None, "b1 c1"), (3, None)]
    got = {r.doc_id: r for r in lm_score.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), slices=2).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, (lp, n) in want.items():
        assert got[i].n_words == n and math.isclose(got[i].log_prob, lp, rel_tol=1e-9, abs_tol=1e-9), i


def test_frequent_bigrams_are_one_row_of_a_document(spark):
    """A third of all words are in pairs held by every tenth document, too few to be hot: they are scored before the shuffle, one row a document."""
    shares = 4
    rows = [(i, " ".join(f"p{i % 10}q{k} r{i % 10}s{k} only{i}at{k}" for k in range(20))) for i in range(200)]
    texts = spark.createDataFrame(rows, "doc_id bigint, t string").coalesce(1)
    counted = texts.select("t").mapInArrow(lm_score._count(16 * shares), "w bigint, n bigint, binned boolean").groupBy("binned", "w").agg(
        F.log(F.sum("n").cast("double")).alias("ln"), F.sum("n").alias("n")).cache()
    words = counted.filter("NOT binned").drop("binned")
    g, own = lm_score.frequent_scores(texts, counted, words, shares)
    pairs = {int(lm_score.pair(*lm_score.word_hashes(f"p{d}q{k} r{d}s{k}").reshape(2, 1))[0]) for d in range(10) for k in range(20)}
    start = np.array([lm_score.START], np.uint64)
    first = {int(lm_score.pair(start, lm_score.word_hashes(f"p{d}q0"))[0]) for d in range(10)}
    assert set(g.tolist()) == pairs | first
    for x, y in zip(g.tolist(), own.tolist()):
        assert math.isclose(y, math.log(20 / 200) if x in first else 0.0, abs_tol=1e-12)
    known = spark.sparkContext.broadcast((g, own))
    out = texts.mapInArrow(lm_score._explode(1, 0, known), "doc_id bigint, g bigint, w bigint, times int, own double").collect()
    summed = [r for r in out if r.own is not None]
    assert sorted(r.doc_id for r in summed) == list(range(200)) and {r.times for r in summed} == {21}
    assert len(out) - len(summed) == 200 * 39 and all(math.isclose(r.own, math.log(0.1)) for r in summed)
    counted.unpersist()
