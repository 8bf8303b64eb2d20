"""E1-E4."""
from pyspark.sql import functions as F

from reqsight.functions.encode import encode_chars, encode_cls_chars


def py_char_ids(text, n=128):
    ids = [ord(c) + 1 if ord(c) < 128 else 129 for c in text[:n]]
    return ids + [0] * (n - len(ids))


def test_encode_chars(spark):
    texts = ["", "GET /a", "café ünïcode", "x" * 300, "emoji 😀 ok"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.ids for r in df.select(encode_chars("t").alias("ids")).collect()]
    assert got == [py_char_ids(t) for t in texts]


def test_encode_cls_chars(spark):
    vocab = {"a": 7, "b": 8, "=": 9, "ab": 99}
    df = spark.createDataFrame([("AB=c",), ("a" * 200,)], "t string")
    r = df.select(encode_cls_chars("t", vocab, max_len=8).alias("e")).collect()
    assert r[0].e.ids == [101, 7, 8, 9, 100, 102, 0, 0] and r[0].e.mask == [1, 1, 1, 1, 1, 1, 0, 0]
    assert r[1].e.ids == [101] + [7] * 6 + [102] and r[1].e.mask == [1] * 8


def test_wordpiece_tiny_vocab(spark):
    from reqsight.operators.wordpiece import SPECIALS, encode_wordpiece
    vocab = {t: i for i, t in enumerate(SPECIALS + ["select", "from", "un", "##ion", "'", "=", "1"])}
    df = spark.createDataFrame([("UNION select 1='1' from Zzz",)], "text string")
    r = encode_wordpiece(df, vocab, "text", max_len=16).first()
    v = vocab
    exp = [v["[CLS]"], v["un"], v["##ion"], v["select"], v["1"], v["="], v["'"], v["1"], v["'"],
           v["from"], v["[UNK]"], v["[SEP]"]]
    assert r.ids[:len(exp)] == exp and sum(r.mask) == len(exp) and len(r.ids) == 16


def test_pieces_match_the_library():
    """The trie's longest match against the tokenizers library, on words over few letters and a vocabulary full of prefixes."""
    import random

    import pytest
    models = pytest.importorskip("tokenizers.models")
    from reqsight.operators.wordpiece import SPECIALS, PieceTrie
    rng = random.Random(4)
    texts = ["a", "b", "##a", "#", "###", *{"##" * rng.randrange(2) + "".join(rng.choice("abc#é") for _ in range(rng.randrange(1, 6))) for _ in range(120)}]
    vocab = {t: i for i, t in enumerate(dict.fromkeys(SPECIALS + texts))}
    library, trie = models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=100), PieceTrie(vocab)
    words = ["".join(rng.choice("abc#é") for _ in range(rng.randrange(1, 30))) for _ in range(3000)] + ["a" * 100, "a" * 101, "日本"]
    several = 0
    for w in words:
        assert trie.split(w) == [t.id for t in library.tokenize(w)], w
        several += len(trie.split(w)) > 1
    assert several > 300


def test_wordpiece_passes_columns_through_and_bounds_the_vocabulary(spark, monkeypatch):
    import pytest
    from reqsight.operators import wordpiece as W
    df = spark.createDataFrame([(1, None, "é x", [1, 2]), (2, "k", None, None)], "mask_id int, key string, text string, list array<int>")
    rows = W.encode_wordpiece(df, W.character_vocab(), "text", max_len=6).collect()
    assert [(r.mask_id, r.key, r.text, r.list) for r in rows] == [(1, None, "é x", [1, 2]), (2, "k", None, None)]
    v = W.character_vocab()
    assert [r.ids for r in rows] == [[2, v["e"], v["x"], 3, 0, 0], [2, 3, 0, 0, 0, 0]] and [sum(r.mask) for r in rows] == [4, 2]
    monkeypatch.setattr(W, "MAX_VOCAB_BYTES", 10)
    with pytest.raises(ValueError):
        W.encode_wordpiece(df, W.character_vocab(), "text")


def test_subword_vocab(tmp_path):
    import json

    from reqsight.operators.wordpiece import SPECIALS, PieceTrie, subword_vocab
    (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": {"un": 3, "u": 0, "u</w>": 1, "\u0120": 2, "ion</w>": 4}}}))
    v = subword_vocab(str(tmp_path / "t.json"))
    assert list(v) == [*SPECIALS, "u", "##u", "un", "##un", "ion", "##ion"] and list(v.values()) == list(range(11))
    assert PieceTrie(v).split("union") == [7, 10] and PieceTrie(v).split("unx") == [1]


def test_char_ngram_features(spark):
    from reqsight.operators.model import char_ngram_features
    df = spark.createDataFrame([("abcd",), ("xyz",)], "text string")
    f = char_ngram_features(df, "text", 3, 1024).select("features").collect()
    assert f[0].features.numNonzeros() == 2 and f[1].features.numNonzeros() == 1


def test_wordpiece_holds_few_rows_at_a_time(spark, monkeypatch):
    """a batch's words become Python objects some rows at a time; ids and order are those of the whole batch."""
    from reqsight.operators import wordpiece as W
    df = spark.range(0, 1000, 1, 1).select("id", F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    whole = [(r.id, r.ids) for r in W.encode_wordpiece(df, W.character_vocab(), "text", max_len=8).collect()]
    v = W.character_vocab()
    assert [i for i, _ in whole] == list(range(1000)) and whole[7][1][:4] == [2, v["w"], v["##7"], 3]
    monkeypatch.setattr(W, "MAX_KNOWN", 3)
    monkeypatch.setattr(W, "ROWS_AT_ONCE", 7)
    assert [(r.id, r.ids) for r in W.encode_wordpiece(df, W.character_vocab(), "text", max_len=8).collect()] == whole
