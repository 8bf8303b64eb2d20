"""Properties (row counts, disjoint complete splits, partition invariance)."""
import urllib.parse

from pyspark.sql import Window, functions as F

from reqsight.functions.augment import augment_payloads, quote_plus
from reqsight.functions.draws import draw
from reqsight.operators import sampling as M
from reqsight.operators.labelling import augment_dataset


def test_dense_index_equals_row_number(spark):
    df = spark.range(3000).withColumn("g", (F.col("id") % 3).cast("int"))
    a = M.dense_index(df, draw("id", "x"), "id", "g", bits=4)
    w = Window.partitionBy("g").orderBy(draw("id", "x"), "id")
    b = df.withColumn("rn", F.row_number().over(w) - 1)
    j = a.join(b, ["id", "g"])
    assert j.filter(F.col("idx") != F.col("rn")).count() == 0
    assert j.count() == 3000


def test_cap_per_class_hot_class(spark):
    # one class holds most rows; cap keeps exactly cap of it, all of the small ones
    df = spark.range(5000).withColumn("label", F.when(F.col("id") < 4000, 1).otherwise(F.col("id") % 3 + 2))
    out = M.cap_per_class(df, "label", "id", cap=700)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts[1] == 700 and all(v <= 700 for v in counts.values())
    assert M.cap_per_class(df.withColumn("label", F.lit(None).cast("int")), "label", "id", 10).count() == 0


def test_splits_disjoint_complete(spark):
    df = spark.range(2000).withColumn("label", (F.col("id") % 4).cast("int")).withColumn("tid", F.col("id") % 17)
    s = M.stratified_split(df, "label", "id", 0.2)
    assert s.count() == 2000 and s.select("id").distinct().count() == 2000
    per = {(r.label, r.split): r["count"] for r in s.groupBy("label", "split").count().collect()}
    assert all(per[(k, "test")] == 100 for k in range(4))
    g = M.random_split(df, "id", 0.2, group_col="tid")
    assert g.groupBy("tid").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0


def test_shuffle_rows_dense(spark):
    s = M.shuffle_rows(spark.range(1234), "id")
    r = s.agg(F.min("row_index"), F.max("row_index"), F.countDistinct("row_index")).first()
    assert tuple(r) == (0, 1233, 1234)


def test_quote_plus_matches_python(spark):
    samples = ["a b", "x*y~z", "1' OR '1'='1", "<script>alert(1)</script>", "é/ü?&=#%", "-_.!()"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r.q for r in df.select(quote_plus(F.col("s")).alias("q")).collect()]
    assert got == [urllib.parse.quote_plus(s) for s in samples]


def test_mutations_change_text_and_keep_class_rules(spark):
    rows = [(i, "id=1' OR '1'='1 UNION SELECT a AND b", "sqli") for i in range(200)]
    rows += [(1000 + i, "../../../etc/passwd", "lfi") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string, label_str string")
    out = augment_payloads(df, "text", "label_str", "id", steps=("sqli", "path")).collect()
    sq = [r.text for r in out if r.label_str == "sqli"]
    assert any("union" in t or "Union" in t for t in sq) and any("UNION" in t for t in sq)
    lfi = [r.text for r in out if r.label_str == "lfi"]
    depths = {t.count("../") for t in lfi}
    assert depths <= set(range(1, 11)) and len(depths) > 5
    targets = {t.split("../")[-1] for t in lfi}
    assert targets <= {"etc/passwd", "etc/shadow", "Windows/win.ini", "boot.ini"}


def test_augment_dataset_size_and_partition_invariance(spark):
    raw = spark.createDataFrame([(i, f"q={i} OR 1=1", "sqli" if i % 2 else "normal", i % 5) for i in range(50)],
                                "id long, text string, label_str string, tid int")
    a = augment_dataset(spark, raw, "id", target=400)
    b = augment_dataset(spark, raw.repartition(7), "id", target=400)
    assert a.count() == 400
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    small = augment_dataset(spark, raw, "id", target=10)   # target below raw: raw only
    assert small.count() == 50 and small.filter("origin = 'aug'").count() == 0


def test_augment_quirks_q14_q15_q16(spark):
    import re
    rows = [(i, "a=1'='1 and 1=1 UNION INFORMATION_SCHEMA", "sqli") for i in range(300)]
    rows += [(1000 + i, "f=../x/../etc/hosts", "traversal") for i in range(100)]
    rows += [(2000 + i, "f=../../../etc/hosts", "traversal") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, text string, label_str string")
    out = {r.id: r.text for r in augment_payloads(df, "text", "label_str", "id", steps=("sqli", "path")).collect()}
    sq = [out[i] for i in range(300)]
    swapped = [t for t in sq if "1'='1" not in t]
    assert swapped and all(re.search(r"(.)'='\1", t) for t in swapped)          # Q14: same char twice
    assert any("1=1" not in t and "1'='1" not in t for t in sq)                 # plain form replaced too
    assert any("INForMATION" in t or "INFOrMATION" in t for t in sq)            # Q16: OR inside INFORMATION
    assert all(out[1000 + i].count("../") == 2 for i in range(100))             # Q15: not contiguous, kept
    assert len({out[2000 + i].count("../") for i in range(100)}) > 3            # contiguous: new depth


def test_augment_dataset_with_string_keys(spark):
    raw = spark.createDataFrame([(f"k{i}", f"q={i}", "normal") for i in range(20)], "id string, text string, label_str string")
    out = augment_dataset(spark, raw, "id", target=50)
    ids = [r.id for r in out.collect()]
    assert len(ids) == 50 and len(set(ids)) == 50
    assert sum(i.startswith("aug:") for i in ids) == 30


def test_texts_are_searched_only_where_a_mutation_applies(spark):
    """a replacement runs in rows of its class that were drawn and hold what it replaces; missing texts and classes stay."""
    texts = ["UNION x' or '1'='1 OR 1=1 alert(1) <script> ../../etc/passwd", "plain", "", None]
    df = spark.createDataFrame([(i, texts[i % 4], [None, "normal", "sqli", "xss", "lfi", "other"][i // 4 % 6]) for i in range(240)], "id int, text string, label_str string")
    out = augment_payloads(df, "text", "label_str", "id", steps=("sqli", "xss", "path"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") >= 14
    rows = {r.id: r for r in out.collect()}
    for i, r in rows.items():
        if r.label_str in (None, "normal", "other") or i % 4:
            assert r.text == texts[i % 4]
    assert {r.label_str for i, r in rows.items() if r.text != texts[i % 4]} == {"sqli", "xss", "lfi"}
