"""L1-L6 against hand-written expectations (not generated from the rule lists)."""
from pyspark.sql import functions as F

from reqsight.functions import rules as L

CASES = [  # title, payload, expected categorize
    ("SQL Injection (Basic)", "x", "sqli"),
    ("NoSQL probe", "<script>", "sqli"),            # 'sql' inside NoSQL, title wins
    ("Source review", "hello", "rce"),              # 'rce' inside 'source'
    ("Cross-Site Scripting", "x", "xss"),
    ("Local File Inclusion", "x", "lfi"),
    ("Directory Traversal", "x", "traversal"),
    ("File upload", "x", "upload"),
    ("Sample 1", "../../etc/passwd", "lfi"),        # lfi rule is before traversal
    ("Sample 2", "..%2F..%2Fx", "traversal"),
    ("Sample 3", "a; cat /x", "rce"),
    ("Sample 4", "1 UNION SELECT 2", "sqli"),
    ("Sample 5", "<SVG onload=1>", "xss"),
    ("Sample 6", "plain text", "other"),
    ("", "doc=..\\win", "traversal"),
    (None, "nothing here", "other"),
]


def test_categorize(spark):
    df = spark.createDataFrame(CASES, "title string, payload string, expected string")
    got = df.select("expected", L.categorize("title", "payload").alias("got")).collect()
    assert [r.got for r in got] == [r.expected for r in got]


def test_title_only_and_payload_default(spark):
    df = spark.createDataFrame([("Generic", "abc")], "title string, payload string")
    r = df.select(L.class_from_title("title").alias("t"), L.class_from_payload("payload").alias("p"),
                  L.class_from_payload("payload", default=None).alias("n")).first()
    assert (r.t, r.p, r.n) == (None, "other", None)


def test_clean_label(spark):
    rows = [(None, "normal"), ("", "normal"), ("['SQLi']", "sqli"), ('"XSS "', "xss"),
            ("normal", "other"), ("Path Traversal", "traversal"), ("weird", "other"),
            ("  ", "other")]
    df = spark.createDataFrame(rows, "raw string, expected string")
    got = df.select("expected", L.clean_label("raw").alias("got"),
                    L.clean_label("raw", strict=True).alias("strict")).collect()
    assert [r.got for r in got] == [r.expected for r in got]
    assert got[4].strict == "normal"


def test_label_id_name(spark):
    df = spark.createDataFrame([("normal",), ("traversal",), ("bogus",)], "n string")
    got = df.select(L.label_id("n").alias("i")).collect()
    assert [r.i for r in got] == [0, 7, None]
    df2 = spark.createDataFrame([(0,), (7,), (8,), (-1,)], "i int")
    assert [r.n for r in df2.select(L.label_name("i").alias("n")).collect()] == ["normal", "traversal", None, None]


def test_label_lines_normal_never_ruled(spark):
    from reqsight.operators.labelling import label_lines
    df = spark.createDataFrame([("Search", "<script>x</script>", False), ("Sample", "<script>", True)],
                               "title string, payload string, is_attack boolean")
    got = label_lines(df).select("label_str", "label").collect()
    assert [(r.label_str, r.label) for r in got] == [("normal", 0), ("xss", 2)]
