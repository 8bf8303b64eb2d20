"""S5, S6, P1-P7."""
import pytest
from pyspark.sql import functions as F

from reqsight.functions import payload as P


def test_assemble_json_order_and_none(spark):
    df = spark.createDataFrame([('{"b": "2", "a": 1, "n": null}',), ("{}",)], "body string")
    got = df.select(P.assemble_payload(P.json_args("body")).alias("p")).collect()
    assert got[0].p == "b=2 a=1 n=None"
    assert got[1].p == ""


def test_form_first_wins_and_decode(spark):
    df = spark.createDataFrame([("a=1&b=x+y&a=2&&c=%3Cb%3E&d",)], "body string")
    got = df.select(P.assemble_payload(P.form_args("body")).alias("p")).first().p
    assert got == "a=1 b=x y c=<b> d="


def test_first_form_values_body_before_query(spark):
    df = spark.createDataFrame([("page=q&z=1", "page=b")], "query string, body string")
    got = df.select(P.assemble_payload(P.first_form_values("query", "body")).alias("p")).first().p
    assert got == "page=b z=1"


def test_request_line_and_canonical(spark):
    df = spark.createDataFrame([("GET", "/a", None)], "m string, p string, q string")
    r = df.select(P.request_line("m", "p", "q").alias("l"),
                  P.canonical_request("m", "p", "q", F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")),
                                      F.lit("x")).alias("c")).first()
    assert r.l == "GET /a "
    assert r.c == "GET [SEP] /a [SEP]  [SEP] a: 1; b: 2 [SEP] x"


def test_split_url(spark):
    df = spark.createDataFrame([("https://h.example.org/p/q?x=1&y=%20#top",)], "u string")
    parts = P.split_url("u")
    r = df.select(parts["host"].alias("h"), parts["path"].alias("p"), parts["query"].alias("q"),
                  P.assemble_payload(parts["args"]).alias("a")).first()
    assert (r.h, r.p, r.q, r.a) == ("h.example.org", "/p/q", "x=1&y=%20", "x=1 y=")


def test_normalise_and_views(spark):
    df = spark.createDataFrame([("%253Cscript%253E",), ("PHNjcmlwdD4=",), ("0x3c62",), ("100%zz",)], "t string")
    got = df.select(P.normalise_payload("t").alias("n"), P.decoded_views("t").alias("v")).collect()
    assert got[0].n == "<script>"
    assert got[0].v == ["%253Cscript%253E", "<script>"]
    assert got[1].v == ["PHNjcmlwdD4=", "<script>"]
    assert got[2].v == ["0x3c62", "<b"]
    assert got[3].n == "100%zz" and got[3].v == ["100%zz"]


def test_empty_payload_predicate(spark):
    df = spark.createDataFrame([("",), (None,), ("x",)], "p string")
    assert [r.e for r in df.select(P.is_empty_payload("p").alias("e")).collect()] == [True, True, False]


def test_json_repeated_key_last_value_first_position(spark):
    df = spark.createDataFrame([('{"a": "1", "b": "x", "a": "2"}',), ("not json",)], "body string")
    got = df.select(P.assemble_payload(P.json_args("body")).alias("p")).collect()
    assert got[0].p == "a=2 b=x"
    assert got[1].p == ""


def test_assemble_sort_keys(spark):
    df = spark.createDataFrame([('{"b": "2", "a": "1"}',)], "body string")
    r = df.select(P.assemble_payload(P.json_args("body"), sort_keys=True).alias("p")).first()
    assert r.p == "a=1 b=2"


def test_split_url_matches_urlsplit_on_pages(spark):
    import urllib.parse
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url")
    parts = P.split_url("url")
    rows = pages.select("url", parts["host"].alias("h"), parts["path"].alias("p"), parts["query"].alias("q")).collect()
    assert len(rows) > 100
    for r in rows:
        u = urllib.parse.urlsplit(r.url)
        assert (r.h, r.p, r.q) == (u.hostname, u.path, u.query if "?" in r.url else None), r.url


def test_views_at_any_depth_and_per_value(spark):
    import base64
    deep = {n: "q=" + "%" + "25" * (n - 1) + "3Cscript" for n in (1, 4, 6)}
    short = "f=" + base64.b64encode(b"../").decode()
    stray = "100%&q=%3Cscript%3E"
    utf8 = "d=" + base64.b64encode("tab\t and \u00e9".encode()).decode()
    rows = [*deep.values(), short, stray, utf8, "menu%20select", "data=0x3c62 x=1", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", P.decoded_views("t").alias("v")).collect()}
    assert all(got[i][1] == "q=<script" for i in range(3))
    assert "../" in got[3] and got[4][1] == "100%&q=<script>" and "tab\t and \u00e9" in got[5] and "<b" in got[7]
    from reqsight.functions.rules import rule_scorer
    types = {r.i: r.c for r in df.select("i", rule_scorer(P.joined_views("t")).alias("c")).collect()}
    assert types[6] == "normal" and types[0] == types[4] == "xss" and types[3] == "traversal"


def test_split_url_on_illegal_characters(spark):
    import random
    import urllib.parse
    rnd = random.Random(11)
    urls = ["http://h.test" + "".join(rnd.choice("/?#&=<>|' \\%^`{}ab\u00e9;:@") for _ in range(rnd.randint(0, 14))).replace("http://h.test", "") for _ in range(300)]
    urls = [u[:13] + "/" + u[13:] for u in urls]
    parts = P.split_url("u")
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    for r in df.select("u", parts["host"].alias("h"), parts["path"].alias("p"), parts["query"].alias("q")).collect():
        w = urllib.parse.urlsplit(r.u)
        assert (r.h, r.p, r.q or "") == (w.hostname, w.path, w.query), r.u


def test_json_booleans_and_nulls(spark):
    df = spark.createDataFrame([('{"a": true, "b": "true", "c": null, "d": 1.5, "e": false}',)], "body string")
    assert df.select(P.assemble_payload(P.json_args("body")).alias("p")).first().p == "a=True b=true c=None d=1.5 e=False"


@pytest.mark.parametrize("text, want", [
    ("%25%33%63", "<"), ("%25%33%63script%25%33%65", "<script>"), ("%2525253c", "<"), ("%25%32%35%33c", "<"),
    ("%25%2532%2535%2533%2543b", "<b"), ("%2525%34%31", "a"), ("a%2Bb", "a b"), ("a%252Bb", "a b"), ("a+b", "a b"),
    ("100%", "100%"), ("%zz%3", "%zz%3"), ("%%33c", "%3c".replace("%3c", "<")), ("", ""), (None, None)])
def test_normalise_to_a_fixpoint(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(P.normalise_payload("t").alias("n")).first().n
    assert got == want


def test_normalise_many_escapes_and_levels(spark):
    """Thousands of escapes in one text and forty levels of one escape; a second run changes nothing."""
    import urllib.parse
    wide = "".join(f"%{b:02X}" for b in b"plain text ") * 3000
    deep = "<"
    for _ in range(40):
        deep = urllib.parse.quote(deep, safe="")
    rows = spark.createDataFrame([(wide,), (deep,)], "t string").select(P.normalise_payload("t").alias("n"))
    assert [r.n for r in rows.collect()] == ["plain text " * 3000, "<"]
    again = rows.select((P.normalise_payload("n") == F.col("n")).alias("same"))
    assert all(r.same for r in again.collect())


def test_views_of_layered_values(spark):
    import base64
    import urllib.parse
    b64 = lambda s: base64.b64encode(s.encode()).decode()
    inner = "<script>x</script>"
    rows = [f"x={b64(inner)}&y=2", f'{{"a":"{b64(inner)}"}}', f"c={b64(urllib.parse.quote(inner))}", f"c={urllib.parse.quote(b64(inner), safe='')};d=1",
            f"c={b64(b64(b64(inner)))}", f"c={b64('0x' + inner.encode().hex())}", f"['{b64(inner)}']", f"<i>{b64(inner)}</i>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", P.decoded_views("t").alias("v")).collect()}
    for i, t in enumerate(rows):
        assert inner in got[i], t
        assert len(set(got[i])) == len(got[i])


def test_scorer_under_when_binds_the_views_once(spark):
    """The plan of W1 holds the view expression once, not once for each keyword."""
    from reqsight.streaming.jobs import score_requests
    df = score_requests(spark.createDataFrame([("x=PHNjcmlwdD4=",), ("",)], "payload string"))
    assert [(r.status, r.type) for r in df.collect()] == [("ATTACK", "xss"), ("ERROR", None)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unbase64") + plan.count("try_to_binary") + plan.count("base64") <= 6


def test_views_with_and_without_plus(spark):
    """the decoding with ``+`` as a space is left out only where no pass meets a ``+``."""
    rows = ["a%2541", "a%2Bb", "a%252Bb", "a%25%32Bb", "a+b", "%2+", "%+", "plain", "", None, "%ff+", "%25%33%63"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    both = F.array(P.url_decode_full(F.col("t")), P.url_decode_full(F.col("t"), plus=False))
    for r in df.select("i", "t", both.alias("b"), P.decoded_views("t").alias("v")).collect():
        assert r.t is None or r.v == list(dict.fromkeys([r.t, *r.b])), r


def test_scorer_lower_cases_once(spark):
    """inside a lambda, where Spark shares no subexpressions, the text is lower-cased once and not for each keyword."""
    from reqsight.functions.rules import rule_scorer
    df = spark.createDataFrame([("A <SCRIPT>", "xss"), ("Plain", "normal"), (None, "normal"), ("1 UNION  ; CAT", "sqli")], "t string, want string")
    got = df.select("want", P.bound(F.col("t"), rule_scorer).alias("c"))
    assert all(r.c == r.want for r in got.collect())
    assert got._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
