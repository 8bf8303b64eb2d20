"""Language ID: blended-spectrum presence kernel, Nystroem landmarks, one-versus-rest kernel ridge regression.

A text is cut into chunks of ``CHUNK`` characters that cover it whole. A chunk's feature set is the presence
of its character n-grams of lengths 1 to ``MAX_N`` (lower-cased, an n-gram belongs to the chunk it starts in),
hashed into ``BUCKETS`` slots; the kernel of two chunks is their number of common slots over the root of the
product of their numbers of slots. ``LANDMARKS`` training chunks give the Nystroem map, a ridge regression of
+1/-1 for each language is solved on the mapped training chunks, and scoring is two matrix products over a batch
of chunks: presence x landmarks, then kernel x weights. A text's margins are the means over its chunks,
weighted by length.

Training takes ``PER_LANG`` different (id, text) pairs of each language, or all if there are fewer, in the order of a hash,
from rows with a language and a text that has a letter whose crc32(id as text) mod ``FOLDS`` is not 0, of the ``MAX_LANGS``
languages with the most such pairs. Texts of any length count alike: a text of up to ``TRAIN_CHUNKS`` chunks gives all of
them, a longer one as many, picked over its whole length by a hash. Only these chunks reach the driver, so the sample is
bounded whatever the lengths and however often an id or a row repeats; the model has a fixed size.
Defined results: a null text, or one without letters, is ``und`` with score 0; a null id is never learned from and
not held out; equal margins go to the first language by name; repeated rows are predicted row by row; without
any training row every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reqsight.llm.common import by_value, pick

by_value(__name__)

FOLDS = 5
PER_LANG = 150
MAX_LANGS = 200
TRAIN_CHUNKS = 8
CHUNK = 2000
MAX_N = 4
BUCKETS = 4096
LANDMARKS = 96
RIDGE = 1e-2
BATCH = 128
SHARPNESS = 4.0


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray   # presence of the landmarks, scaled by 1 / root of their sizes: (BUCKETS, m)
    weights: np.ndarray     # (m, languages)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def presence(chunks: list[np.ndarray]) -> np.ndarray:
    """Rows of 0/1 floats. A chunk comes with the up to MAX_N - 1 characters that follow it in its text."""
    out = np.zeros((len(chunks), BUCKETS), np.float32)
    for row, c in enumerate(chunks):
        own = min(len(c), CHUNK)
        h = np.zeros(len(c), np.uint64)
        for n in range(1, MAX_N + 1):
            if len(c) < n:
                break
            h = (h[:len(c) - n + 1] + c[n - 1:]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            out[row, ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(52))[:own]] = 1
    return out


def chunks_of(text: str) -> tuple[list[np.ndarray], list[int]]:
    c = code_points(text)
    starts = range(0, len(c), CHUNK)
    return [c[s:s + CHUNK + MAX_N - 1] for s in starts], [min(CHUNK, len(c) - s) for s in starts]


def train(rows: list[tuple[str, str]]) -> Model | None:
    """``rows``: (text or chunk, language), in a fixed order."""
    if not rows:
        return None
    langs = sorted({lang for _, lang in rows})
    chunks, labels = [], []
    for text, lang in rows:
        mine = [code_points(text)] if len(text) <= CHUNK + MAX_N - 1 else chunks_of(text)[0]
        chunks += mine
        labels += [langs.index(lang)] * len(mine)
    labels = np.array(labels)
    p = np.concatenate([presence(chunks[i:i + BATCH]) for i in range(0, len(chunks), BATCH)])
    p /= np.sqrt(np.maximum(1, p.sum(1, keepdims=True)))
    order = [i for turn in range(len(labels)) for lang in range(len(langs))
             for i in np.flatnonzero(labels == lang)[turn:turn + 1]][:LANDMARKS]  # languages in turn
    marks = p[order].T
    values, vectors = np.linalg.eigh((marks.T @ marks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = (p @ marks).astype(np.float64) @ root
    target = np.where(labels[:, None] == np.arange(len(langs)), 1.0, -1.0)
    share = np.bincount(labels, minlength=len(langs))[labels]
    w = (1 / share)[:, None]  # every language weighs the same
    ridge = np.linalg.solve(phi.T @ (w * phi) + RIDGE * np.eye(phi.shape[1]) / len(langs), phi.T @ (w * target))
    return Model(langs, np.ascontiguousarray(marks, np.float32), (root @ ridge).astype(np.float32))


def margins(model: Model, chunks: list[np.ndarray]) -> np.ndarray:
    p = presence(chunks)
    size = np.sqrt(np.maximum(1, p.sum(1, keepdims=True)))
    return (p @ model.landmarks / size) @ model.weights


def predict(model: Model | None, texts: list[str | None]) -> Iterator[tuple[str, float]]:
    """(language, score) of each text, in batches of BATCH chunks, whatever a text's length."""
    sums = np.zeros((len(texts), len(model.langs) if model else 1))
    waiting: list[np.ndarray] = []
    owner: list[int] = []
    weight: list[int] = []
    lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]

    def flush():
        if waiting:
            np.add.at(sums, owner, margins(model, waiting) * np.array(weight)[:, None])
            waiting.clear(), owner.clear(), weight.clear()

    for i, text in enumerate(texts):
        if not lettered[i] or model is None:
            continue
        total = len(text.lower())
        for c, n in zip(*chunks_of(text)):
            waiting.append(c), owner.append(i), weight.append(n / total)
            if len(waiting) == BATCH:
                flush()
    flush()
    for i in range(len(texts)):
        if not lettered[i] or model is None:
            yield "und", 0.0
            continue
        best = int(sums[i].argmax())
        odds = np.exp(SHARPNESS * (sums[i] - sums[i].max()))
        yield model.langs[best], float(odds[best] / odds.sum())


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def picked_chunks(text: Column, seed: list[Column], step: int, lead: int, tail: int, most: int,
                  shared: int = 0) -> Column:
    """Pieces of a text that start every ``step`` characters (but for the last ``shared`` steps, part of the piece before), with ``lead`` characters before and ``tail`` after: all of up
    to ``most``, else that many different ones by a hash of ``seed``. An array of (at, piece)."""
    n = F.greatest(F.ceil(F.length(text) / F.lit(step)).cast("bigint") - shared, F.lit(1).cast("bigint"))
    some = F.slice(F.array_sort(F.transform(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(4 * most)), lambda i: F.pmod(F.xxhash64(*seed, i), n))),
                                            lambda i: F.struct(F.xxhash64(*seed, i, F.lit(1)).alias("h"), i.alias("i")))), 1, most)
    at = F.when(n <= most, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.transform(some, lambda x: x["i"]))
    start = lambda i: F.greatest(i * step - lead, F.lit(0))
    return F.transform(F.array_sort(at), lambda i: F.struct(i.alias("at"), text.substr(
        (start(i) + 1).cast("int"), (i * step - start(i) + step + tail).cast("int")).alias("piece")))


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
           per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """The bounded training sample of (chunk, language), in a fixed order."""
    rows = pick(docs, doc_id=doc_id, t=text, lang=lang).filter(
        F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), FOLDS, 0) & F.col("lang").isNotNull() & F.col("t").rlike(r"\p{L}"))
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), "t", F.xxhash64("t").alias("h"))
    # pairs without texts, repeats counted away: an id or a row on a third of the table is a few rows from here on
    pairs = rows.groupBy("lang", "doc_id", "h").agg(F.count("*").alias("n"))
    kinds = pairs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MAX_LANGS).select(F.col("lang").alias("k_lang"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "h"), "doc_id", "h")
    ids = pairs.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_lang).join(F.broadcast(kinds), F.col("lang") == F.col("k_lang"))
    ids = ids.select(F.col("lang").alias("s_lang"), F.col("doc_id").alias("s_id"), F.col("h").alias("s_h"))
    got = rows.join(F.broadcast(ids), (F.col("doc_id") == F.col("s_id")) & (F.col("lang") == F.col("s_lang")) & (F.col("h") == F.col("s_h")))
    parts = picked_chunks(F.col("t"), [F.col("doc_id"), F.col("h")], CHUNK, 0, MAX_N - 1, TRAIN_CHUNKS)
    got = got.groupBy("lang", "doc_id", "h").agg(F.first(parts).alias("c"))
    rows = sorted((r["lang"], str(r["doc_id"]), r["h"], r["c"]) for r in got.collect())
    return [(c["piece"], lg) for lg, _, _, chunks in rows for c in chunks]


def _mapper(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(predict(shared.value, batch.column("t").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc_id", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    rows = pick(docs, doc_id=doc_id, t=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about BUCKETS x LANDMARKS floats
    return rows.mapInArrow(_mapper(shared), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
