"""Spark column expressions vs plain-Python semantics on generated strings (hypothesis)."""
import urllib.parse

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from reqsight.functions.augment import quote_plus
from reqsight.functions.encode import encode_chars
from reqsight.functions.text import py_strip, split_first

ALPHABET = st.sampled_from(list("ab Z09:%'\"<>/.-_~*+&=;|$") + [
    ": ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", "　", "​",
    "é", "ß", "Ω", "中", "😀", "%41", "%zz", "%C3%A9"])
TEXTS = st.lists(st.lists(ALPHABET, max_size=30).map("".join), min_size=1, max_size=60)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def py_char_ids(text, n=128):
    ids = [ord(c) + 1 if ord(c) < 128 else 129 for c in text[:n]]
    return ids + [0] * (n - len(ids))


@SETTINGS
@given(TEXTS)
def test_strip_split_encode_quote(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    s = py_strip(F.col("t"))
    before, after = split_first(s, ": ")
    rows = df.select("i", s.alias("s"), before.alias("b"), after.alias("a"),
                     encode_chars("t", 16).alias("e"), quote_plus(F.col("t")).alias("q")).collect()
    for r in sorted(rows, key=lambda r: r.i):
        t = texts[r.i]
        assert r.s == t.strip()
        parts = t.strip().split(": ", 1)
        assert (r.b, r.a) == ((parts[0], parts[1]) if len(parts) == 2 else (None, parts[0]))
        assert r.e == py_char_ids(t, 16)
        assert r.q == urllib.parse.quote_plus(t)


from reqsight.fixed import PAYLOAD_RULES, TITLE_RULES  # noqa: E402
from reqsight.functions.rules import categorize  # noqa: E402

FRAGMENTS = st.sampled_from(
    [k for _, ks in TITLE_RULES for k in ks] + [k for _, ks in PAYLOAD_RULES for k in ks]
    + ["SQL", "XsS", "Cross-Site", "UNION ", "Select ", "../", "..\\", "Ü", "ß", "İ", " ", "a", "1", "'", "=", "|", ";"])
PIECES = st.lists(FRAGMENTS, max_size=6).map("".join)


def py_categorize(title, payload):
    t, p = title.lower(), payload.lower()
    for cls, ks in TITLE_RULES:
        if any(k in t for k in ks):
            return cls
    for cls, ks in PAYLOAD_RULES:
        if any(k in p for k in ks):
            return cls
    return "other"


@SETTINGS
@given(st.lists(st.tuples(PIECES, PIECES), min_size=1, max_size=60))
def test_categorize_matches_first_match_semantics(spark, pairs):
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(pairs)], "i int, t string, p string")
    for r in df.select("i", categorize("t", "p").alias("c")).collect():
        assert r.c == py_categorize(*pairs[r.i])


from reqsight.fixed import CLEAN_ORDER  # noqa: E402
from reqsight.functions.rules import clean_label  # noqa: E402

LABEL_BITS = st.sampled_from(["[", "]", '"', "'", " ", "SQLi", "xss", "Normal", "other", "LFI", "rce",
                              "upload", "Traversal", "x", "é", "-"])


def py_clean_label(raw):
    if raw is None:
        return "normal"
    cleaned = raw.strip("[]\"' ").lower()
    for c in CLEAN_ORDER:
        if c in cleaned:
            return c
    return "other" if raw else "normal"


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.lists(LABEL_BITS, max_size=5).map("".join)), min_size=1, max_size=60))
def test_clean_label_matches_python(spark, raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, r string")
    for row in df.select("i", clean_label("r").alias("c")).collect():
        assert row.c == py_clean_label(raws[row.i])


import json  # noqa: E402

from reqsight.functions.encode import encode_cls_chars  # noqa: E402
from reqsight.functions.payload import assemble_payload, json_args  # noqa: E402

VOCAB = {"a": 7, "b": 8, "=": 9, "é": 10, "<": 11}


def py_cls_encode(text, n=16):
    body = [VOCAB.get(c, 100) for c in text.lower()[: n - 2]]
    ids = [101] + body + [102] + [0] * (n - 2 - len(body))
    return ids, [1] * (len(body) + 2) + [0] * (n - 2 - len(body))


@SETTINGS
@given(TEXTS)
def test_cls_encoder_matches_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", encode_cls_chars("t", VOCAB, 16).alias("e")).collect():
        assert (r.e.ids, r.e.mask) == py_cls_encode(texts[r.i])


KEYS = st.lists(ALPHABET, min_size=1, max_size=4).map("".join)
VALS = st.lists(ALPHABET, max_size=8).map("".join)


@SETTINGS
@given(st.lists(st.dictionaries(KEYS, VALS, max_size=4), min_size=1, max_size=40))
def test_assemble_payload_matches_python(spark, bodies):
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i int, body string")
    for r in df.select("i", assemble_payload(json_args("body")).alias("p")).collect():
        exp = " ".join(f"{k}={v}" for k, v in bodies[r.i].items()).strip()
        assert r.p == exp


import urllib.parse as _up  # noqa: E402

from reqsight.functions.payload import form_args  # noqa: E402

FORM_BITS = st.sampled_from(["a", "b", "K", "=", "&", "+", "%41", "%C3%A9", "%20", "x", "é", " "])


def py_form(body):
    """Form dict with the first value of a repeated key (to_dict semantics), blank values kept."""
    out = {}
    for k, v in _up.parse_qsl(body, keep_blank_values=True):
        out.setdefault(k, v)
    return " ".join(f"{k}={v}" for k, v in out.items()).strip()


@SETTINGS
@given(st.lists(st.lists(FORM_BITS, max_size=12).map("".join), min_size=1, max_size=60))
def test_form_args_match_python(spark, bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    for r in df.select("i", assemble_payload(form_args("b")).alias("p")).collect():
        assert r.p == py_form(bodies[r.i]), bodies[r.i]
