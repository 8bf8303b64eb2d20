"""Quality classifier: a byte-level convolutional network in numpy.

Input symbols are the bytes of the UTF-8 text, each with one more bit that says whether the ``GRAM`` bytes that
start there also started at most ``LAG`` bytes earlier, so that filters can see repetition. ``FILTERS`` learned filters of
``WIDTH`` symbols slide over the whole text; their outputs are max-pooled over chunks of two blocks of ``BLOCK`` bytes
that overlap by one block and cover the document from the first byte to the last; the rectified chunk features are
averaged and a logistic unit combines them into one probability. A filter is a table with one row for each symbol
and place, so the convolution is a sum of table look-ups.

Training (backpropagation with Adam) takes ``PER_CLASS`` different (id, text) pairs of each class, or all if there are
fewer, in the order of a hash, from labelled ids with a text whose crc32(id as text) mod ``FOLDS`` is not ``HELD``. Texts of
any length count alike: one of up to ``TRAIN_CHUNKS`` blocks gives all its chunks, a longer one as many, picked over its
whole length by a hash. Only these reach the driver, however long a text is and however often an id or a row repeats.
Scoring reads every byte of every text.
Defined results: a null or empty text has no chunk and gets the probability of zero features; a null id is never
learned from and not held out; an id labelled twice counts with each label; without labels of both classes
every score is 0.5; repeated rows are scored row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reqsight.llm.common import by_value, pick, restore, with_columns
from reqsight.llm.langid import in_fold, picked_chunks

by_value(__name__)

FOLDS, HELD = 3, 1
PER_CLASS = 600
TRAIN_CHUNKS = 24
BLOCK = 128
WIDTH = 6
FILTERS = 16
GRAM, LAG = 4, 40
EPOCHS, RATE, BATCH = 30, 0.02, 64
PIECE = 512 * BLOCK  # bytes convolved at once


@dataclass
class Model:
    filters: np.ndarray  # (WIDTH, 512, FILTERS)
    bias: np.ndarray     # (FILTERS,)
    out: np.ndarray      # (FILTERS,)
    base: float


def symbols(text: str) -> np.ndarray:
    """Bytes 0-255 of the text, plus 256 where the next GRAM bytes repeat ones begun up to LAG bytes before."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = len(raw) - GRAM + 1
    out = raw.astype(np.uint16)
    if n > 1:
        code = raw[:n].astype(np.uint32)
        for k in range(1, GRAM):
            code = code << np.uint32(8) | raw[k:k + n]
        again = np.zeros(n, bool)
        for lag in range(2, min(LAG, n - 1) + 1):
            again[lag:] |= code[lag:] == code[:-lag]
        out[:n][again] += 256
    return out


def block_maxima(filters: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Largest filter outputs in each block of BLOCK positions; the last WIDTH - 1 places see zero symbols."""
    out = []
    for start in range(0, len(s), PIECE):
        part = s[start:start + PIECE + WIDTH - 1]
        n = min(PIECE, len(s) - start)
        if len(part) < n + WIDTH - 1:
            part = np.concatenate([part, np.zeros(n + WIDTH - 1 - len(part), s.dtype)])
        y = filters[0][part[:n]]
        for k in range(1, WIDTH):
            y += filters[k][part[k:k + n]]
        out.append(np.maximum.reduceat(y, np.arange(0, n, BLOCK), axis=0))
    return np.concatenate(out)


def score(model: Model | None, text: str | None) -> float:
    """Probability of label 1."""
    if model is None:
        return 0.5
    logit = model.base
    if text:
        m = block_maxima(model.filters, symbols(text))
        chunks = np.maximum(m[:-1], m[1:]) if len(m) > 1 else m  # two blocks each, one shared with the next
        logit += float(np.maximum(chunks + model.bias, 0).mean(0) @ model.out)
    return float(1 / (1 + np.exp(-np.clip(logit, -50, 50))))


def train(rows: list[tuple[list[tuple[int, str]], int]], seed: int = 17) -> Model | None:
    """``rows``: (a text's pieces as (characters before the chunk, piece), label 0 or 1), in a fixed order."""
    rows = [r for r in rows if r[0]]
    if len({y for _, y in rows}) < 2:
        return None
    rng = np.random.default_rng(seed)
    size = 2 * BLOCK + WIDTH - 1
    chunks, owner, labels = [], [], np.array([y for _, y in rows], np.float64)
    for i, (parts, _) in enumerate(rows):
        for lead, piece in parts:
            got = symbols(piece)[len(piece[:lead].encode("utf-8", "replace")):][:size]
            c = np.zeros(size, np.uint16)
            c[:len(got)] = got
            chunks.append((c, min(2 * BLOCK, len(got))))
            owner.append(i)
    x, own = np.stack([c for c, _ in chunks]), np.array(owner)
    live = np.array([n for _, n in chunks])
    per = np.bincount(own, minlength=len(rows))
    share = 1 / np.where(labels == 1, (labels == 1).sum(), (labels == 0).sum()) * len(rows) / 2
    p = {"filters": rng.normal(0, 0.1, (WIDTH, 512, FILTERS)), "bias": np.zeros(FILTERS),
         "out": rng.choice([-0.5, 0.5], FILTERS), "base": np.zeros(1)}
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    of = [np.flatnonzero(own == i) for i in range(len(rows))]
    for _ in range(EPOCHS):
        for docs in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            at = np.concatenate([of[i] for i in docs])
            local = np.repeat(np.arange(len(docs)), per[docs])
            b = x[at]
            f32 = p["filters"].astype(np.float32)
            y = sum(f32[k][b[:, k:k + 2 * BLOCK]] for k in range(WIDTH))
            y[np.arange(2 * BLOCK)[None, :] >= live[at][:, None]] = -1e9
            arg = y.argmax(1)
            top = np.take_along_axis(y, arg[:, None, :], 1)[:, 0, :] + p["bias"]
            h = np.maximum(top, 0)
            mean = np.zeros((len(docs), FILTERS))
            np.add.at(mean, local, h)
            mean /= per[docs][:, None]
            prob = 1 / (1 + np.exp(-np.clip(mean @ p["out"] + p["base"][0], -50, 50)))
            g = (prob - labels[docs]) * share[docs] / len(docs)
            gm = (g[:, None] * p["out"])[local] / per[docs][local][:, None] * (top > 0)
            grad = {"out": mean.T @ g + 1e-4 * p["out"], "base": np.array([g.sum()]), "bias": gm.sum(0), "filters": 1e-5 * p["filters"]}
            lines, cols = np.arange(len(at))[:, None], np.arange(FILTERS)[None, :]
            for k in range(WIDTH):
                np.add.at(grad["filters"][k], (b[lines, arg + k], np.broadcast_to(cols, arg.shape)), gm)
            step += 1
            for k, v in p.items():
                m1, m2 = mom[k]
                m1 += 0.1 * (grad[k] - m1)
                m2 += 0.001 * (grad[k] ** 2 - m2)
                v -= RATE * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    return Model(p["filters"].astype(np.float32), p["bias"].astype(np.float32), p["out"].astype(np.float32), float(p["base"][0]))


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
           per_class: int = PER_CLASS) -> list[tuple[list[tuple[int, str]], int]]:
    """The bounded training sample of (pieces, label), in a fixed order."""
    marked = pick(labels, doc_id="doc_id", y=label).filter(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~in_fold(F.col("doc_id"), FOLDS, HELD))
    marked = marked.select("doc_id", F.col("y").cast("int").alias("y")).distinct()
    rows = pick(docs, doc_id=doc_id, t=text).filter(F.col("doc_id").isNotNull() & (F.col("t") != "")).withColumn("h", F.xxhash64("t"))
    # pairs without texts, repeats counted away on both sides: no key brings more than its different texts to the join
    pairs = rows.groupBy("doc_id", "h").agg(F.count("*").alias("n")).join(marked, "doc_id")
    first = Window.partitionBy("y").orderBy(F.xxhash64("doc_id", "h"), "doc_id", "h")
    ids = pairs.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_class)
    ids = ids.select(F.col("doc_id").alias("s_id"), F.col("h").alias("s_h"), "y")
    got = rows.join(F.broadcast(ids), (F.col("doc_id") == F.col("s_id")) & (F.col("h") == F.col("s_h")))
    parts = picked_chunks(F.col("t"), [F.col("doc_id"), F.col("h")], BLOCK, LAG, BLOCK + WIDTH + GRAM, TRAIN_CHUNKS, 1)
    got = got.groupBy("y", "doc_id", "h").agg(F.first(parts).alias("c"))
    rows = sorted((str(r["doc_id"]), r["h"], r["y"], r["c"]) for r in got.collect())
    return [([(min(LAG, c["at"] * BLOCK), c["piece"]) for c in chunks], y) for _, _, y, chunks in rows]


def _mapper(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t")
            got = pa.array((score(shared.value, texts[i].as_py()) for i in range(batch.num_rows)), pa.float64())
            names = [n for n in batch.schema.names if n != "t"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], got], names=[*names, "score"])
    return run


def score_quality(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, score."""
    rows = pick(docs, doc_id=doc_id, t=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH x 512 x FILTERS floats
    return rows.mapInArrow(_mapper(shared), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns."""
    flat, names = with_columns(docs, t=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema.fields if f.name != "t")
    return restore(flat.mapInArrow(_mapper(shared), f"{kinds}, score double").filter(F.col("score") >= least), names)
