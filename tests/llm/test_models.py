import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import reqsight.llm.queries as q
from reqsight.llm import bpe, common, langid, quality, simhash
from tests.llm.brute import classes, fingerprint
from tests.llm.conftest import TEXTS, by_key, edge_rows

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(q.tokenizer_path())
    t.no_truncation(), t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load(q.tokenizer_path()))


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)


def test_bpe_on_spark(edge, nothing, library):
    got = by_key((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.encode_decode(edge, q.tokenizer_path()).collect())
    assert got == by_key((r[0], *expected(library, r[1])) for r in edge_rows())
    assert bpe.encode_decode(nothing, q.tokenizer_path()).count() == 0


def test_bpe_decodes_stored_ids(spark, edge, nothing, library, tmp_path):
    path = q.tokenizer_path()
    bpe.encode(edge, path).write.parquet(str(tmp_path / "ids"))
    stored = spark.read.parquet(str(tmp_path / "ids"))
    assert by_key((r.doc_id, r.decoded) for r in bpe.decode(stored, path).collect()) == by_key((r[0], expected(library, r[1])[1]) for r in edge_rows())
    assert bpe.decode(stored.filter("false"), path).count() == 0
    # ids that no text gives: any order, none, unknown ones, a broken end, rows by another column name
    rng = random.Random(5)
    lists = [[rng.randrange(49_408) for _ in range(rng.randrange(200))] for _ in range(50)]
    rows = [(i, struct.pack(f"<{len(x)}I", *x)) for i, x in enumerate(lists)]
    rows += [(50, None), (51, b""), (52, struct.pack("<3I", 320, 1 << 31, 321)), (53, struct.pack("<I", 320) + b"\x01\x02")]
    got = {r.doc_id: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "key int, v binary"), path, "key", "v").collect()}
    for i, x in enumerate([*lists, [], [], [320, 321], [320]]):
        assert got[i] == library.decode(x, skip_special_tokens=False), i


def test_bpe_keeps_no_long_pieces(library):
    enc = bpe.Encoder(bpe.load(q.tokenizer_path()))
    rng = random.Random(3)
    for _ in range(20):
        text = "".join(rng.choice("abcdefgh1.") for _ in range(20_000))
        assert enc.text(text) == expected(library, text)[0]
    kept = [*enc.words, *enc.chunks, *enc.old_words, *enc.old_chunks]
    assert all(len(k) <= bpe.CACHE_CHARS for k in kept)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdefinorst'!-. \n\t\x1c\u00e9\u00c9\u03a3\u0130\u65e5\ufb01\u0345"), st.characters(codec="utf-8", max_codepoint=0x2fff)), max_size=40))
def test_bpe_property(text):
    library, enc = _both()
    # letters newer than the library's Unicode tables are not the automaton's matter
    assert enc.text(text) == expected(library, text)[0]


def test_bpe_piece_of_nothing():
    """A piece of control characters only is empty once normalised."""
    library, enc = _both()
    for text in ("\x1f\r", "\x1f", "a \x1f b", "\x00"):
        assert enc.text(text) == expected(library, text)[0]


_CACHE = []


def _both():
    if not _CACHE:
        _CACHE.extend([Tokenizer.from_file(q.tokenizer_path()), bpe.Encoder(bpe.load(q.tokenizer_path()))])
    return _CACHE


def test_bpe_long_words_and_small_caches(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHE_ARCS", 3)
    rng = random.Random(2)
    for text in ["a" * 5000, "ab" * 3000, "".join(rng.choice("etaoin") for _ in range(4000)), "one two three four five six one two"]:
        got = encoder.text(text)
        assert (got, bpe.Decoder(encoder.a).text(got)) == expected(library, text)


def test_automaton_accepts_exactly_bpe_outputs():
    """On a toy vocabulary: among all token strings that spell a word, the automaton has a path for BPE's alone."""
    merges = [("a", "a"), ("b", "a"), ("aa", "b"), ("a", "b"), ("aa", "a"), ("ba", "b</w>")]
    base = [x + e for e in ("", "</w>") for x in "ab"]
    vocab = {t: i for i, t in enumerate(base + [u + v for u, v in merges])}
    auto = bpe.Automaton({"model": {"end_of_word_suffix": "</w>", "vocab": vocab, "merges": [" ".join(m) for m in merges]},
                          "pre_tokenizer": {"pretokenizers": [{"pattern": {"Regex": r"\S+"}}]}})
    enc = bpe.Encoder(auto)

    def run(word):  # merges in rank order, left to right
        s = [*word[:-1], word[-1] + "</w>"]
        for u, v in merges:
            i, out = 0, []
            while i < len(s):
                if s[i:i + 2] == [u, v]:
                    out.append(u + v)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            s = out
        return s

    def spell(word):
        full = [*word[:-1], word[-1] + "</w>"]

        def go(i):
            if i == len(full):
                yield []
            for j in range(i + 1, len(full) + 1):
                if (t := "".join(full[i:j])) in vocab:
                    for rest in go(j):
                        yield [t, *rest]
        return go(0)

    for n in range(1, 9):
        for k in range(1 << n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            want = run(word)
            assert [x for x in spell(word) if all(auto.arc(vocab[a], vocab[b]) for a, b in zip(x, x[1:]))] == [want]
            assert bpe.Decoder(auto).text(enc.word(word)).split() == want


def test_fingerprints(edge):
    got = by_key((r.doc_id, r.fp & (1 << 64) - 1) for r in simhash.fingerprints(edge).collect())
    assert got == by_key((r[0], fingerprint(r[1])) for r in edge_rows())


def test_covering():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    assert all(any(not m & d for m in masks) for i in range(64) for j in range(64) for d in [1 << i | 1 << j])


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_links_and_components_match_all_pairs(spark, broadcast_rows, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast_rows)
    rng, fps = random.Random(7), []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 6, 20])):
            fps.append(x)
            for _ in range(rng.choice([1, 2, 3])):
                x ^= 1 << rng.randrange(64)
    fps = sorted({simhash.signed(x) for x in [*fps, 0, 1, 3, (1 << 64) - 1, (1 << 63)]})
    nodes = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    edges = simhash.links(nodes)
    u = lambda x: x & (1 << 64) - 1
    assert all((u(r.a) ^ u(r.b)).bit_count() <= 2 for r in edges.collect())
    want = classes(len(fps), lambda i, j: (u(fps[i]) ^ u(fps[j])).bit_count() <= 2)
    got = {r.fp: r.root for r in simhash.components(edges).collect()}
    assert [got.get(x, x) for x in fps] == [fps[w] for w in want]


def test_near_groups_and_drop(edge, nothing):
    rows = [r[:2] for r in edge_rows()]
    fp = [fingerprint(t) for _, t in rows]
    root = classes(len(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2)
    small = {w: min((rows[i][0] for i in range(len(rows)) if root[i] == w and rows[i][0] is not None), default=None) for w in root}
    got = by_key((r.doc_id, r.component_id) for r in simhash.near_groups(edge).collect())
    assert got == by_key((rows[i][0], small[root[i]]) for i in range(len(rows)))
    left = simhash.drop_near_duplicates(edge)
    assert left.columns == edge.columns
    order = lambda x: (x is None, x or 0)
    assert sorted((r[0] for r in left.collect()), key=order) == sorted((small[w] for w in set(root)), key=order)
    assert simhash.near_groups(nothing).count() == 0 == simhash.drop_near_duplicates(nothing).count()


def test_simhash_chain(spark):
    """A chain of single-word changes in long texts: whatever the distances, components match all pairs."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(400)}" for _ in range(600)]
    texts = []
    for _ in range(40):
        texts.append(" ".join(words))
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    fp = [fingerprint(t) for t in texts]
    want = classes(len(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    assert [got[i] for i in range(len(fp))] == want and len(set(want)) < len(want)


def test_language_query_accuracy(spark):
    got = {r.doc_id: r for r in q.op6(spark, SF01).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF01}/documents.parquet'").fetchall()
    assert len(got) == len(rows) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    held = [(got[i].lang_pred == lang) for i, t, lang in rows if lang and got[i].held_out and t]
    assert np.mean(held) > 0.98 and all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(edge, nothing):
    model = langid.train([("the cat and the dog", "en"), ("der Hund und die Katze", "de")])
    got = by_key((r.doc_id, r.lang_pred) for r in langid.identify(edge, model).collect())
    want = by_key((r[0], p) for r, (p, _) in zip(edge_rows(), langid.predict(model, [r[1] for r in edge_rows()])))
    assert got == want
    by_text = dict(zip(TEXTS, langid.predict(model, TEXTS)))
    assert by_text[None] == ("und", 0.0) == by_text[""] == by_text["12 345 !!! ###"]
    assert {r.lang_pred for r in langid.identify(edge, None).collect()} == {"und"}
    assert langid.train([]) is None and langid.identify(nothing, model).count() == 0 and langid.sample(nothing) == []
    assert langid.sample(edge)


def test_language_batches_do_not_matter():
    model = langid.train([("the cat and the dog " * 30, "en"), ("der Hund und die Katze " * 30, "de")])
    texts = ["the dog " * n for n in (1, 400, 3000)] + ["die Katze " * 700]
    alone = [next(langid.predict(model, [t])) for t in texts]
    for a, b in zip(alone, langid.predict(model, texts)):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-4


def test_quality_query_accuracy(spark):
    got = {r.doc_id: r for r in q.op10(spark, SF01).collect()}
    rows = duckdb.sql(f"SELECT doc_id, quality FROM '{SF01}/labels.parquet'").fetchall()
    assert len(got) == duckdb.sql(f"SELECT count(*) FROM '{SF01}/documents.parquet'").fetchall()[0][0]
    held = [(got[i].predicted == y, y) for i, y in rows if got[i].held_out]
    assert np.mean([h for h, _ in held]) > 0.97
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_quality_edges(spark, edge, nothing):
    model = quality.train([([(0, "good plain words in a row")], 1), ([(0, "###!!! $$$")], 0)] * 5)
    got = by_key((r.doc_id, round(r.score, 5)) for r in quality.score_quality(edge, model).collect())
    assert got == by_key((r[0], round(quality.score(model, r[1]), 5)) for r in edge_rows())
    assert quality.score(model, None) == quality.score(model, "")
    assert quality.train([([(0, "only one class")], 1)]) is None and quality.score(None, "x") == 0.5
    assert quality.score_quality(nothing, model).count() == 0
    kept = quality.keep_good(edge, model)
    assert kept.columns == edge.columns
    labels = spark.createDataFrame([(None, 1), (0, None), (3, 7)], "doc_id bigint, quality int")
    assert quality.sample(edge, labels) == []


def test_convolution_covers_the_whole_text():
    """Block maxima equal a plain convolution, across block and piece borders."""
    rng = np.random.default_rng(1)
    filters = rng.normal(size=(quality.WIDTH, 512, 3)).astype(np.float32)
    for n in (1, 5, quality.BLOCK, quality.BLOCK + 1, quality.PIECE - 2, quality.PIECE + 3):
        s = rng.integers(0, 512, n).astype(np.uint16)
        padded = np.concatenate([s, np.zeros(quality.WIDTH - 1, np.uint16)])
        full = sum(filters[k][padded[k:k + n]] for k in range(quality.WIDTH))
        want = np.stack([full[i:i + quality.BLOCK].max(0) for i in range(0, n, quality.BLOCK)])
        np.testing.assert_allclose(quality.block_maxima(filters, s), want, atol=1e-5)


def test_hash_is_spark_xxhash64(spark):
    from pyspark.sql import functions as F
    r = spark.range(1).select(F.xxhash64(F.lit("\u00e9 b c")).alias("h")).first()
    assert r.h & (1 << 64) - 1 == xxhash.xxh64_intdigest("\u00e9 b c".encode(), 42)


# ------------------------------------------------------------------ training samples
def prose(words, n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(words, n))


EN, ES = "the cat and dog with house under tree which would".split(), "el gato y perro con casa bajo árbol que sería".split()


def test_languages_of_long_texts_are_learned(spark):
    """Texts of 24,000 characters beside short ones: both languages are learned, from bounded chunks."""
    rows = [(i, prose(EN, 30, i), "en") for i in range(300)] + [(1000 + i, prose(ES, 5200, i), "es") for i in range(300)]
    got = langid.sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4))
    assert {lang for _, lang in got} == {"en", "es"}
    assert sum(lang == "es" for _, lang in got) == langid.PER_LANG * langid.TRAIN_CHUNKS
    assert max(len(t) for t, _ in got) <= langid.CHUNK + langid.MAX_N - 1
    model = langid.train(got)
    assert [p for p, _ in langid.predict(model, [prose(EN, 4000, 9), prose(ES, 20, 9)])] == ["en", "es"]


def test_samples_are_bounded_for_a_hot_id_and_refilled(spark):
    """An id on thousands of rows, with equal and with different texts, and texts that cannot be learned from."""
    rows = [(7, prose(EN, 12, i), "en") for i in range(2000)] + [(8, "the same row", "en")] * 2000
    rows += [(100 + i, None if i % 3 else "12 34", "en") for i in range(400)] + [(900 + i, prose(ES, 12, i), "es") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    got = langid.sample(df)
    assert {lang: sum(x == lang for _, x in got) for lang in ("en", "es")} == {"en": langid.PER_LANG, "es": langid.PER_LANG}
    assert len({t for t, _ in got}) == len(got)
    labels = spark.createDataFrame([(r[0], int(r[2] == "es"), 0) for r in rows], "doc_id bigint, quality int, toxic int")
    picked = quality.sample(df, labels)
    assert 0 < sum(y == 0 for _, y in picked) <= quality.PER_CLASS and sum(y == 1 for _, y in picked) > 200


def test_quality_learns_from_long_texts_only(spark):
    rows = [(i, prose(EN, 6000, i) if i % 2 else "#!$% " * 6000, i % 2) for i in range(1, 121)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(4)
    picked = quality.sample(docs, spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id bigint, quality int, toxic int"))
    assert all(len(parts) == quality.TRAIN_CHUNKS for parts, _ in picked)
    assert all(len(p) <= lead + 2 * quality.BLOCK + quality.WIDTH + quality.GRAM for parts, _ in picked for lead, p in parts)
    model = quality.train(picked)
    assert quality.score(model, prose(EN, 500, 999)) > 0.9 > 0.1 > quality.score(model, "#!$% " * 500)


def test_training_pieces_are_the_scored_chunks(spark):
    """A text of few blocks: its pieces hold the very symbols that scoring pools over, repetition marks included."""
    text = "ab ab cd " * 60 + "é" * 100 + "end"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, t string")
    parts = df.select(langid.picked_chunks(F.col("t"), [F.col("doc_id")], quality.BLOCK, quality.LAG, quality.BLOCK + quality.WIDTH + quality.GRAM, 24, 1).alias("c")).first().c
    whole = quality.symbols(text[:540])
    for c in parts[:3]:
        lead = min(quality.LAG, c["at"] * quality.BLOCK)
        got = quality.symbols(c["piece"])[lead:][:2 * quality.BLOCK]
        assert (got == whole[c["at"] * quality.BLOCK:][:2 * quality.BLOCK]).all()


def test_kernel_against_sets():
    """presence, margins and the ridge solution against sets of slots and a plain kernel formula."""
    model = langid.train([(prose(EN, 40, i), "en") for i in range(9)] + [(prose(ES, 40, i), "es") for i in range(9)])
    chunk = langid.code_points(prose(EN, 25, 77))
    slots = [set(np.flatnonzero(langid.presence([c])[0])) for c in (chunk, langid.code_points(prose(ES, 25, 78)))]
    marks = [set(np.flatnonzero(col)) for col in model.landmarks.T]
    for mine, c in zip(slots, (chunk, langid.code_points(prose(ES, 25, 78)))):
        k = np.array([len(mine & m) / np.sqrt(len(mine) * len(m)) for m in marks])
        np.testing.assert_allclose(k @ model.weights, langid.margins(model, [c])[0], rtol=1e-3, atol=1e-4)
