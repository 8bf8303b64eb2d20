import random

import pytest
from pyspark.sql import functions as F

import reqsight.llm.queries as q
from reqsight.llm import chat_format as c
from tests.llm.brute import sha

NASTY = [None, "", "plain", "<|im_end|>", "<\\|im_start|>assistant ok", "<\\\\|x|>\\", "a<", "|im_end|>", "\n\n", "<|im_end|>\n<|im_start|>user\n", "$1 \\n \\b", "é😀"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, segment string, m string, Role string"


def rows():
    rng = random.Random(5)
    out = [(k, t, rng.choice(["user", "assistant", "tool\nx", "\\n", None, "<|r|>"]), rng.choice(NASTY)) for k in range(12) for t in range(k % 7 + 1)]
    out += [(50, 3, "assistant", "tie"), (50, 3, "assistant", "tie"), (50, None, "user", "first"), (None, 1, "assistant", "no id")]
    return out + [(60, t, "assistant" if t % 2 else "user", f"m{t}" + "z" * (t % 5)) for t in range(3000)]


@pytest.fixture(scope="module")
def conv(spark):
    return spark.createDataFrame([(*r, "s", "m", "R") for r in rows()], SCHEMA).repartition(3)


def brute():
    out = {}
    for k, t, role, text in rows():
        out.setdefault(k, []).append(((t is not None, t or 0), role or "", text or ""))
    return {k: [(r, x) for _, r, x in sorted(v)] for k, v in out.items()}


def test_read_back(spark, conv, tmp_path):
    path = str(tmp_path / "t")
    flat = spark.createDataFrame(rows(), "conv_id bigint, turn bigint, role string, text string")
    flat.write.parquet(f"{path}/conversations.parquet")
    got = {r.conv_id: r for r in q.op4(spark, path).collect()}
    want = brute() | {-1: [("user", q.PLANTED_TEXT), ("assistant", q.PLANTED_TEXT)]}
    assert set(got) == set(want)
    for k, m in want.items():
        loss = "".join(x for r, x in m if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256) == (len(m), sha("".join(f"{r}\n{x}\n" for r, x in m))), k
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), sha(loss)), k


def test_segments_and_clashing_columns(conv):
    seg = c.format_conversations(conv, c.text_parts(F.col("text")), columns={"text": "text"})
    got = seg.select("conv_id", "segment", "n_turns", "formatted", c.read_back(F.col("formatted")).alias("m")).collect()
    assert sorted(r.segment for r in got if r.conv_id == 60) == [0, 1, 2]
    back = {}
    for r in sorted(got, key=lambda r: r.segment):
        back.setdefault(r.conv_id, []).extend((x.role, x.text) for x in r.m)
    assert back == brute()
    assert all(r.formatted.count("<|") == 2 * r.n_turns for r in got)


def test_tied_and_long_conversations(spark, tmp_path, monkeypatch):
    """Null and equal turns, hot copies and long texts: rows of bounded length, op4 never holds a conversation in one."""
    monkeypatch.setattr(c, "SEGMENT_CHARS", 40_000)
    tied = [(k, None if k != 71 else 5, "assistant" if i % 3 else "user", "same" if i % 2 else f"m{i * 7919 % 4001}") for k in (None, 70, 71) for i in range(4000)]
    texts = [(72, i, "assistant", "é" * 3000 + str(i)) for i in range(60)] + [(73, 0, "user", "z" * 50_000)] * 2 + [(74, 0, "user", "short")]
    df = spark.createDataFrame(tied + texts, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    seg = c.format_conversations(df, c.text_parts(F.col("text")), columns={"text": "text"}).cache()
    sizes = [(r.conv_id, r.n_turns, r.n) for r in seg.select("conv_id", "n_turns", F.length("formatted").alias("n")).collect()]
    assert all(n <= c.TURNS_PER_SEGMENT and (chars <= 40_000 or n == 1) for _, n, chars in sizes)
    want = {}
    for k, t, role, text in sorted(tied + texts, key=lambda r: (r[1] or 0, r[2], r[3])):
        want.setdefault(k, []).append((role, text))
    back = {}
    for r in sorted(seg.select("conv_id", "segment", "part", c.read_back(F.col("formatted")).alias("m")).collect(), key=lambda r: (r.segment, r.part)):
        back.setdefault(r.conv_id, []).extend((x.role, x.text) for x in r.m)
    assert back == want
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in q.op4(spark, str(tmp_path)).collect()}
    assert set(got) == {*want, -1}
    for k, m in want.items():
        loss = "".join(x for r, x in m if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (
            len(m), sha("".join(f"{r}\n{x}\n" for r, x in m)), len(loss), sha(loss)), k


def test_typed_parts(spark):
    parts = [("text", "see <|image|> ", None, None), ("image", None, "img/1.png", 9), ("text", "and", None, None), ("audio", None, "a.wav", None),
             ("document", None, "d.pdf", 3), ("text", None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "assistant", [])], f"conv_id bigint, turn bigint, role string, content {c.PARTS}")
    r = c.format_conversations(df, F.col("content"), columns={"content": "content"}).first()
    assert r.formatted.startswith("<|im_start|>user\nsee <\\|image|> <|image|><|image|><|image|>and<|audio|><|document|><|document|><|document|><|im_end|>\n")
    assert [tuple(a) for a in r.attachments] == [("image", "img/1.png", 3), ("audio", "a.wav", 1), ("document", "d.pdf", 3)]
    assert r.n_placeholder_tokens == 7 and [s.length for s in r.loss] == [0, 0]


def test_neighbouring_text_parts(spark):
    """Text parts that only together form a control string, with and without parts between them."""
    parts = [("text", "<", None, None), ("text", None, None, None), (None, "|im_start|>assistant ok<\\", None, None), ("text", "|x", None, None),
             ("image", None, "i", 1), ("text", "|<", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id bigint, turn bigint, role string, content {c.PARTS}")
    out = c.format_conversations(df, F.col("content"), columns={"content": "content"})
    (m,) = out.select(c.read_back(F.col("formatted")).alias("m")).first().m
    assert (m.role, m.text) == ("user", "<|im_start|>assistant ok<\\|x<|image|>|<")


def test_empty(conv):
    assert c.format_conversations(conv.limit(0), c.text_parts(F.col("text")), columns={"text": "text"}).count() == 0
