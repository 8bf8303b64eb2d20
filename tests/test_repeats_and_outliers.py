"""M1 and M3 on repeated keys, A8 and A9 on outliers and special values."""
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reqsight.operators import evaluate as A, sampling as M


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("hot", [1, 3, 8])
def test_cap_is_exact_for_repeated_keys(spark, same, hot):
    """A key on 4,000 of 5,000 rows, equal rows or rows that differ, wherever its draw falls among the others."""
    df = spark.range(5000).select(F.when(F.col("id") < 4000, hot).otherwise(F.col("id")).alias("id"), F.lit("sqli").alias("label"),
                                  F.when(F.lit(same) & (F.col("id") < 4000), 0).otherwise(F.col("id")).alias("row"))
    df = df.unionByName(spark.range(10).select(F.col("id") + 9000, F.lit("xss").alias("label"), F.lit(1).cast("bigint").alias("row")).toDF("id", "label", "row"))
    got = M.cap_per_class(df, cap=2000)
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {"sqli": 2000, "xss": 10}
    assert not got.exceptAll(df).head(1)
    again = M.cap_per_class(df.repartition(5), cap=2000)
    assert not got.exceptAll(again).head(1)
    split = M.stratified_split(df, test=0.2)
    assert {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()} == {
        ("sqli", "test"): 1000, ("sqli", "train"): 4000, ("xss", "test"): 2, ("xss", "train"): 8}
    assert not split.drop("split").exceptAll(df).head(1) and split.count() == df.count()


def test_cap_keeps_map_columns(spark):
    df = spark.range(30).select((F.col("id") % 3).alias("id"), F.lit(1).alias("label"), F.create_map(F.lit("k"), F.lit("v")).alias("m"))
    assert M.cap_per_class(df, cap=7).select("m").count() == 7


def test_outlier_leaves_buckets_even(spark):
    """One value of 1e12 among 200,000: no bucket holds more than a few hundredths of the distinct values."""
    s = spark.range(200_000).select(F.lit(1).alias("g"), (F.col("id") / 200_000).alias("v")).union(spark.range(1).select(F.lit(1), F.lit(1e12)))
    most = A._buckets(s, ["g"], "v").groupBy("_b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_b").collect()
    assert max(r.n for r in most) <= 8000
    assert all(a.hi < b.lo for a, b in zip(most, most[1:]))


def brute_auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    key = lambda x: (math.isnan(x), 0 if math.isnan(x) else x)
    return sum((key(p) > key(n)) + 0.5 * (key(p) == key(n)) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_and_percentiles_of_special_values(spark):
    special = [math.inf, -math.inf, math.nan, 0.0, 1e300, -1e300, 5e-324]
    rows = [(special[i % 7] if i % 3 else (i * 37 % 101) / 7.0, i % 2 == 0) for i in range(400)]
    df = spark.createDataFrame([(*r, "a") for r in rows], "s double, y boolean, g string")
    got = A.roc_auc(df, "s", "y").first()
    assert math.isclose(got.auc, brute_auc(rows), rel_tol=1e-12) and (got.n_pos, got.n_neg) == (200, 200)
    ordered = sorted((s for s, _ in rows), key=lambda x: (math.isnan(x), 0 if math.isnan(x) else x))
    r = A.latency_summary(df, "s", "g").first()
    assert r.p50 == ordered[math.ceil(0.5 * 400) - 1] and r.n == 400
    assert Counter([math.isnan(r.p99)]) == Counter([math.isnan(ordered[math.ceil(0.99 * 400) - 1])])


def test_null_scores_are_left_out(spark):
    df = spark.createDataFrame([(0.1, False), (0.9, True), (None, True), (None, False)], "s double, y boolean")
    assert A.roc_auc(df, "s", "y").first().asDict() == {"auc": 1.0, "n_pos": 1, "n_neg": 1}
