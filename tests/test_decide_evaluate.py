"""D1-D7 and A3-A10 against hand-computed values and brute force."""
import itertools
import math

import pytest
from pyspark.sql import functions as F

from reqsight.functions import decide as D
from reqsight.operators import evaluate as A


def test_softmax_argmax_ties(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0],)], "z array<double>")
    r = df.select(D.softmax("z").alias("p"), D.argmax("z").alias("i"), D.decide("z").alias("d")).first()
    assert r.i == 1
    assert math.isclose(sum(r.p), 1.0)
    assert r.d.type == "sqli" and math.isclose(r.d.confidence, r.p[1])


def test_verdict_and_outcome(spark):
    df = spark.createDataFrame([("normal", "a=1"), ("xss", "q=<"), ("error", "x"), ("xss", "")],
                               "t string, p string")
    got = df.select(D.verdict("t", "p").alias("v")).select("v.status", "v.type").collect()
    assert [(r.status, r.type) for r in got] == [("NORMAL", "normal"), ("ATTACK", "xss"),
                                                 ("ATTACK", "error"), ("ERROR", None)]
    got2 = df.select(D.verdict_status("t", "p", on_error="ERROR").alias("s")).collect()
    assert got2[2].s == "ERROR"
    o = df.select(D.outcome(D.verdict_status("t", "p")).alias("o")).collect()
    assert [r.o for r in o] == ["ALLOWED", "BLOCKED", "BLOCKED", "ALLOWED"]


def test_api_record(spark):
    df = spark.createDataFrame([("sqli", 0.97)], "t string, c double")
    r = df.select(D.api_record("t", "c", "m1").alias("r")).first().r
    assert (r.is_attack, r.confidence, r.model, r.attack_type) == (True, 0.97, "m1", "SQLI")


PAIRS = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (2, 2), (0, 0), (3, 0)]


def sk_weighted(pairs):
    labels = sorted({x for p in pairs for x in p})
    tot = len(pairs)
    out = {"precision": 0.0, "recall": 0.0, "f1": 0.0}
    for c in labels:
        tp = sum(1 for a, b in pairs if a == c and b == c)
        sup = sum(1 for a, _ in pairs if a == c)
        prd = sum(1 for _, b in pairs if b == c)
        p = tp / prd if prd else 0.0
        r = tp / sup if sup else 0.0
        f = 2 * p * r / (p + r) if p + r else 0.0
        for k, v in (("precision", p), ("recall", r), ("f1", f)):
            out[k] += v * sup / tot
    return out


def test_weighted_prf_and_report(spark):
    df = spark.createDataFrame(PAIRS, "label int, pred int")
    w = A.weighted_prf(df).first()
    exp = sk_weighted(PAIRS)
    for k in exp:
        assert math.isclose(w[k], exp[k], abs_tol=1e-12)
    assert math.isclose(w.accuracy, 5 / 8)
    rep = {r["class"]: r for r in A.classification_report(df).collect()}
    assert set(rep) == {"normal", "sqli", "xss", "lfi", "accuracy", "macro avg", "weighted avg"}
    assert rep["lfi"].support == 1 and rep["lfi"].precision == 0.0      # never predicted -> 0
    assert math.isclose(rep["accuracy"].f1, 5 / 8)
    assert A.accuracy(df).first().accuracy == 5 / 8


def brute_auc(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_roc_auc_ties_against_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows = [(float(rnd.randint(0, 30)), rnd.random() < 0.4) for _ in range(400)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    got = A.roc_auc(df, "s", "y").first()
    assert math.isclose(got.auc, brute_auc(rows), abs_tol=1e-12)
    g = spark.createDataFrame([(i % 2, s, y) for i, (s, y) in enumerate(rows)], "g int, s double, y boolean")
    by = {r.g: r.auc for r in A.roc_auc(g, "s", "y", group="g").collect()}
    for k in (0, 1):
        assert math.isclose(by[k], brute_auc([r for i, r in enumerate(rows) if i % 2 == k]), abs_tol=1e-12)


def test_cross_entropy(spark):
    z = [0.5, 1.5, -1.0, 0.0, 0.0, 0.0, 0.0, 2.0]
    df = spark.createDataFrame([(z, 1), (z, 7)], "logits array<double>, label int")
    lse = math.log(sum(math.exp(x) for x in z))
    exp = ((lse - z[1]) + (lse - z[7])) / 2
    assert math.isclose(A.cross_entropy(df).first().cross_entropy, exp, rel_tol=1e-12)


def test_latency_summary(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("v"))
    r = A.latency_summary(df, "v").first()
    assert (r.n, r.mean, r.p50, r.p95, r.p99) == (100, 50.5, 50.0, 95.0, 99.0)
