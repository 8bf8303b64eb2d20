"""Phrase collocation mining with an FM-index per shard over word ids.

A shard is up to ``SHARD_WORDS`` words of one group (language), read by one task: its pieces lie end to end, each
closed by the id 0, and every distinct word has an id. Two Burrows-Wheeler transforms are built, of that line and of
its reverse, sorted to the depth of the longest phrase. A phrase is a pair of intervals, one in each index, of equal
length: its count. Reading the symbols in the reverse index's interval gives all words that can follow (right
extensions), those in the forward index's interval all that can come before (left extensions), each with its count and
its own pair of intervals. All phrases of a length are extended at once, to the right and to the left in turn.

Shards' counts are summed by phrase, whole: a phrase seen once in a shard may be frequent in all. Only then are the
phrases below ``min_count`` left out, and the rest is relational: a candidate's cuts are joined with the counts of
their parts (hot words by ``attach``), and each phrase's largest count among its one-word extensions to either side
says whether a longer phrase covers it.

The best of a group are found in ``TOP_PARTS`` parts first, so the last window reads a bounded number of rows for each.

Pieces are what ``[.,;:!?\\n\\v\\f\\r]`` leaves, words what spaces and tabs leave, A-Z lower-cased. Defined results:
null text counts as empty, null groups as ``und``; phrases never cross pieces or rows; repeated rows count each time;
a score is exact (integers of up to 38 digits); equal rows are ranked by phrase in UTF-8 byte order; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from reqsight.llm.common import attach, by_value, checkpoint, pick

by_value(__name__)

MAX_WORDS = 3
MIN_COUNT = 10
#: Percent of a phrase's count at which a longer phrase covers it.
COVERED = 50
TOP = 2000
SHARD_WORDS = 3 << 19
#: Phrases of a shard that leave a task at once.
OUT_ROWS = 1 << 17
#: Parts into which a group's candidates are dealt before the first TOP of each part meet.
TOP_PARTS = 64
#: In decimals of 38 digits: counts of up to 10^15 are exact.
SCORE = "cast(cast(a as decimal(18,0)) * cast(a as decimal(18,0)) * 1000000 as decimal(38,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
_TO_MARK = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\n" * 10)


def pieces(text: str | None) -> list[list[bytes]]:
    """The pieces of a text that have words, as lists of words."""
    lines = (text or "").encode().lower().translate(_TO_MARK).split(b"\n")
    return [[w for w in line.replace(b"\t", b" ").split(b" ") if w] for line in lines if line.strip(b" \t")]


class Words(dict):
    """Ids from 1 in order of first sight."""

    def __missing__(self, word):
        self[word] = n = len(self) + 1
        return n


class Index:
    """One direction of the bidirectional index: the transform of ``line``, its symbol starts and rank look-ups."""

    def __init__(self, line: np.ndarray, symbols: int, depth: int):
        key = line.astype(np.int64)
        for d in range(1, depth):
            if key.max() > (1 << 62) // symbols:
                key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            key = key * symbols + np.roll(line, -d)
        order = np.argsort(key, kind="stable")
        self.bwt = line[order - 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=symbols))])
        self.n = len(line)
        self._places = None

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before a place."""
        if self._places is None:  # (symbol, place) in order, as one number each
            self._places = np.sort(self.bwt.astype(np.int64) * self.n + np.arange(self.n))
        return np.searchsorted(self._places, symbol * self.n + upto) - self.starts[symbol]


def extend(ahead: Index, lo: np.ndarray, size: np.ndarray, other_lo: np.ndarray, symbols: int, last: bool = False):
    """All one-word extensions of disjoint intervals of ``ahead`` (lo, size); ``other_lo`` are their twins' starts.

    Returns (parent, symbol, size, lo, other_lo) of each extension; the intervals are not needed after the ``last``.
    """
    parent = np.repeat(np.arange(len(lo)), size)
    place = np.arange(len(parent)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    key, n = np.unique(parent * symbols + ahead.bwt[place], return_counts=True)
    parent, symbol = np.divmod(key, symbols)
    new_lo = new_other = None
    if not last:
        before = np.cumsum(n) - n  # extensions of one parent are in order of their symbol, in the twin's interval too
        first = np.searchsorted(parent, parent)
        new_other = other_lo[parent] + before - before[first]
        new_lo = ahead.starts[symbol] + ahead.rank(symbol, lo[parent])
    real = symbol > 0
    keep = (lambda x: x[real]) if not real.all() else (lambda x: x)
    return keep(parent), keep(symbol), keep(n), None if last else keep(new_lo), None if last else keep(new_other)


def shard_phrases(line: np.ndarray, symbols: int, depth: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, bool]]:
    """The phrases of each length up to ``depth`` in a line of pieces, length by length: their word ids by position,
    their counts, the place of the phrase (one word shorter) that each extends, in its order, and whether to the left."""
    forward, backward = Index(line, symbols, depth), Index(line[::-1], symbols, depth)
    ids = np.arange(1, symbols)
    size = np.diff(forward.starts)[1:]
    words, lo, back_lo = [ids], forward.starts[1:-1], backward.starts[1:-1]
    yield words, size, np.zeros(len(ids), np.int64), False
    for n in range(2, depth + 1):
        if n % 2 == 0:
            parent, symbol, size, back_lo, lo = extend(backward, back_lo, size, lo, symbols, n == depth)
            words = [*[w[parent] for w in words], symbol]
        else:
            parent, symbol, size, lo, back_lo = extend(forward, lo, size, back_lo, symbols, n == depth)
            words = [symbol, *[w[parent] for w in words]]
        yield words, size, parent, n % 2 == 1


def _counter(depth: int, shard_words: int, packed: bool):
    def flush(group, ids: Words, parts: list[np.ndarray]):
        """A row for each phrase but the longest; a row of the last length but one also lists its extensions."""
        line = np.concatenate([np.zeros(1, np.int64), *parts])
        total = int((line > 0).sum())
        # ids in the order of the words, so that neighbouring rows begin alike and compress well
        texts = sorted(ids)
        place = np.zeros(len(ids) + 1, np.int64)
        place[np.fromiter(map(ids.__getitem__, texts), np.int64, len(ids))] = np.arange(1, len(ids) + 1)
        line, texts = place[line], pa.array([b"", *texts], pa.binary()).cast(pa.string())
        levels = shard_phrases(line, len(ids) + 1, depth)
        yield batch_of(group, pa.array([""]), np.array([total]), None)
        words, n, _, _ = next(levels)
        for length in range(2, depth + 2):
            longer = next(levels, None)
            for i in range(0, len(n), OUT_ROWS):
                at = slice(i, i + OUT_ROWS)
                phrase = pc.binary_join_element_wise(*[texts.take(pa.array(w[at])) for w in words], " ")
                more = None
                if packed and length == depth:
                    a, b = np.searchsorted(longer[2], [i, i + len(phrase)])
                    cuts = pa.array(np.searchsorted(longer[2][a:b], np.arange(i, i + len(phrase) + 1)).astype(np.int32))
                    new = longer[0][0 if longer[3] else -1][a:b]
                    often = np.add.reduceat(np.append(longer[1][a:b] > 1, False), cuts[:-1]) * (np.diff(cuts) > 0) > 0
                    more = [pc.binary_join(pa.ListArray.from_arrays(cuts, x), " ") for x in (texts.take(pa.array(new)), pa.array(longer[1][a:b]).cast(pa.string()))]
                    more[1] = pc.if_else(pa.array(often), more[1], pa.scalar(None, pa.string()))  # null: each extension once
                yield batch_of(group, phrase, n[at], more)
            if longer is None or (packed and length == depth):
                return
            words, n = longer[:2]

    def batch_of(group, phrase, n, more):
        more = more or [pa.nulls(len(phrase), pa.string())] * 2
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(group), len(phrase)), phrase, pa.array(n.astype(np.int64)), *more], names=["lang", "stem", "n", "more", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shards, held = {}, 0
        for batch in batches:
            for group, text in zip(batch.column("lang").to_pylist(), batch.column("t")):
                lists = pieces(text.as_py())
                if not lists:
                    continue
                ids, parts, sizes = open_shards.setdefault(group, (Words(), [], [0]))
                flat = []
                for words in lists:
                    flat.extend(map(ids.__getitem__, words))
                    flat.append(0)
                parts.append(np.array(flat, np.int64))
                sizes[0] += len(flat)
                held += len(flat)
                if held >= shard_words:  # the largest group's shard is closed, so few groups or many, memory is bounded
                    most = max(open_shards, key=lambda g: open_shards[g][2][0])
                    ids, parts, sizes = open_shards.pop(most)
                    held -= sizes[0]
                    yield from flush(most, ids, parts)
        for group, (ids, parts, _) in open_shards.items():
            yield from flush(group, ids, parts)
    return run


def phrase_counts(docs: DataFrame, group: str = "lang", text: str = "text", max_words: int = MAX_WORDS,
                  shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, phrase, a): every phrase of up to ``max_words`` words; the phrase '' carries a group's number of words."""
    rows = pick(docs, lang=group, t=text)
    rows = rows.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "t")
    # The longest phrases travel as lists beside the phrase that they extend: half the rows, and rows of one stem meet in one
    # task anyway. A single word is not a stem, as all that follows a frequent one would meet in one task. A shard's phrases
    # are distinct, its index has summed them, so a sum before the shuffle would find nothing to merge.
    packed = max_words > 2
    shards = rows.mapInArrow(_counter(max_words, shard_words, packed), "lang string, stem string, n bigint, more string, times string")
    shards = shards.repartition("lang", "stem")
    new = F.split("more", " ")
    times = F.coalesce(F.split("times", " ").cast("array<bigint>"), F.array_repeat(F.lit(1).cast("bigint"), F.size(new)))
    added = F.when(F.length("more") > 0, F.arrays_zip(new.alias("add"), times.alias("n")))
    itself = F.array(F.struct(F.lit("").alias("add"), F.col("n")))
    each = shards.select("lang", "stem", F.explode(F.concat(itself, F.coalesce(added, F.expr("array()")))).alias("x")).select("lang", "stem", "x.add", "x.n")
    sums = each.groupBy("lang", "stem", "add").agg(F.sum("n").alias("a"))
    longest = (F.concat("add", F.lit(" "), "stem") if max_words % 2 else F.concat("stem", F.lit(" "), "add"))
    return sums.select("lang", F.when(F.col("add") == "", F.col("stem")).otherwise(longest).alias("phrase"), "a")


def collocations(docs: DataFrame, group: str = "lang", text: str = "text", max_words: int = MAX_WORDS,
                 min_count: int = MIN_COUNT, covered: int = COVERED, top: int = TOP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The first ``top`` phrases of each group: lang, rank, phrase, a, l, r, n, score."""
    counts = phrase_counts(docs, group, text, max_words, shard_words)
    # a part is at least as frequent as its phrase, so no count below min_count is looked up
    known = checkpoint(counts.filter((F.col("a") >= min_count) | (F.col("phrase") == ""))
                       .select("lang", "phrase", "a", F.size(F.split("phrase", " ")).alias("len")))
    totals = known.filter("phrase = ''").select("lang", F.col("a").alias("n"))
    known = known.filter("phrase <> ''")
    table = known.select(F.struct("lang", "phrase").alias("p"), F.col("a").alias("of"))
    longer = known.filter("len > 1")
    words = F.split("phrase", " ")
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "len", "k", F.struct("lang", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("phrase")).alias("left"),
                       F.struct("lang", F.array_join(F.slice(words, F.col("k") + 1, F.col("len")), " ").alias("phrase")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = attach(cuts, table.toDF(side, name), side, name, "phrase")
    score = F.expr(SCORE)
    scored = cuts.groupBy("lang", "phrase", "a", "len").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s"))
    extended = longer.filter("len > 2").select("lang", "a", F.explode(F.array(
        F.array_join(F.slice(words, F.lit(1), F.col("len") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("len") - 1), " "))).alias("phrase"))
    extended = extended.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = scored.join(extended, ["lang", "phrase"], "left").filter(
        F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * covered))
    kept = kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS))
    first = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

