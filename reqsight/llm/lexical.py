"""Ranked lexical search over an inverted index, by hybrid term-at-a-time and document-at-a-time evaluation.

Index: each task packs its documents into segments of up to ``SEGMENT_WORDS`` words, one row each: the documents' ids
and lengths, the terms, and for each term the list of (document, occurrences) in document order. A segment's documents
fall into windows of ``WINDOW``; terms in more than ``SHORT`` documents also carry, for each window, their largest
number of occurrences and the shortest document, from which an upper bound of their score there follows. Every term of
every document is indexed, whatever will be asked; nothing is shuffled.

Search: the queries are taken in blocks of bounded size. For a block, one pass over the lists' lengths gives the
document frequencies, a second one scores. Of a query's lists in a segment the short ones are added up term at a time
into accumulators, which from then on count as one more list with its own bounds. The windows are then visited in
document order: a window whose bounds sum to less than the query's k-th best score so far is skipped. In a window that
is not, the lists with the smallest bounds that together cannot reach that score are set aside; candidates come from
the other lists only, and the set-aside ones are searched for just those candidates that could still enter. A task
keeps each query's best k over all its segments and returns these; a window over them picks the k best of all.

Scores are integers, see ``weight`` and ``gain``. Defined results: terms are runs of ASCII letters, digits and
characters beyond ASCII, A-Z lower-cased; null and empty texts have none and are never found; equal scores go by
ascending id, null ids last; rows that repeat an id are documents of their own; repeated (item, text) rows are one
query; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reqsight.llm.common import by_value, checkpoint, pick
from reqsight.session import remove_path, shared_path

by_value(__name__)

TOP = 10
SEGMENT_WORDS = 1 << 20
WINDOW = 256
#: Lists up to this length in a segment are short.
SHORT = 128
#: Bounds of one block of queries: what is collected and sent to every task.
BLOCK_ITEMS = 2000
BLOCK_BYTES = 4 << 20
_TO_TERMS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_INDEX = "docs bigint, words bigint, terms binary, starts binary, lens binary, at binary, tf binary, long binary, most binary, least binary"


def terms_of(text) -> list[bytes]:
    return (text or "").encode().translate(_TO_TERMS).split()


class Ids(dict):
    """Numbers from 0 in order of first sight."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _segment(doc_ids: list, id_type, ids: Ids, parts: list[np.ndarray]) -> pa.RecordBatch:
    lens = np.array([len(p) for p in parts], np.int64)
    n = len(parts)
    key, tf = np.unique(np.concatenate(parts).astype(np.int64) * n + np.repeat(np.arange(n), lens), return_counts=True)
    term, at = np.divmod(key, n)
    starts = np.searchsorted(term, np.arange(len(ids) + 1))
    windows = -(-n // WINDOW)
    long = np.flatnonzero(np.diff(starts) > SHORT)
    most, least = np.zeros((len(long), windows), np.int64), np.zeros((len(long), windows), np.int64)
    for i, t in enumerate(long):
        mine = slice(starts[t], starts[t + 1])
        w, first = np.unique(at[mine] // WINDOW, return_index=True)
        most[i, w] = np.maximum.reduceat(tf[mine], first)
        least[i, w] = np.minimum.reduceat(lens[at[mine]], first)
    blob = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
    cols = {"ids": pa.array([doc_ids], pa.list_(id_type)), "docs": pa.array([n]), "words": pa.array([int(lens.sum())]),
            "terms": pa.array([b" ".join(ids)], pa.binary()), "starts": blob(starts, np.int64), "lens": blob(lens, np.int64),
            "at": blob(at, np.int32), "tf": blob(tf, np.int64 if tf.max() >> 31 else np.int32), "long": blob(long, np.int64),
            "most": blob(most, np.int64), "least": blob(least, np.int64)}
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _builder(segment_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, ids, parts, held, kind = [], Ids(), [], 0, None
        for batch in batches:
            kind = batch.column("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("t")):
                found = terms_of(text.as_py())
                if not found:
                    continue
                doc_ids.append(doc)
                parts.append(np.fromiter(map(ids.__getitem__, found), np.int32, len(found)))
                held += len(found)
                if held >= segment_words:
                    yield _segment(doc_ids, kind, ids, parts)
                    doc_ids, ids, parts, held = [], Ids(), [], 0
        if parts:
            yield _segment(doc_ids, kind, ids, parts)
    return run


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """One row per segment; holds every row that has a term. Write it once and search it often."""
    rows = pick(docs, doc_id=doc_id, t=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_builder(segment_words), f"ids array<{kind}>, {_INDEX}")


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def damping(lens: np.ndarray, docs: int, words: int) -> np.ndarray:
    """The part of a document's length in its scores: 10 + 90 * length / mean length, rounded down."""
    if len(lens) and 90 * docs * int(lens.max()) >= 1 << 63:
        return np.array([10 + 90 * int(n) * docs // words for n in lens], np.int64)
    return 10 + 90 * lens * docs // words


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Segment:
    """A segment's row, opened for a block's terms and the corpus statistics."""

    def __init__(self, row: dict, weights: dict[bytes, int], docs: int, words: int):
        self.ids, self.n = row["ids"], row["docs"]
        starts = np.frombuffer(row["starts"], np.int64)
        self.m = damping(np.frombuffer(row["lens"], np.int64), docs, words)
        at = np.frombuffer(row["at"], np.int32)
        tf = np.frombuffer(row["tf"], np.int32 if len(row["tf"]) == len(row["at"]) else np.int64)
        self.windows = -(-self.n // WINDOW)
        place = {int(t): i for i, t in enumerate(np.frombuffer(row["long"], np.int64))}
        shape = len(place), self.windows
        most, least = np.frombuffer(row["most"], np.int64).reshape(shape), np.frombuffer(row["least"], np.int64).reshape(shape)
        self.short, self.long = {}, {}
        for i, t in enumerate(row["terms"].split(b" ")):
            w = weights.get(t, 0)
            if w > 0:
                a, b = starts[i], starts[i + 1]
                if i in place:
                    top, low = most[place[i]], least[place[i]]
                    cuts = a + np.searchsorted(at[a:b], np.arange(self.windows + 1) * WINDOW)
                    self.long[t] = Postings(w, at, tf, self.m, cuts, w * gain(top, damping(low, docs, words)))
                else:
                    self.short[t] = at[a:b], w * gain(tf[a:b].astype(np.int64), self.m[at[a:b]])


class Postings:
    """A long list: scores are worked out only for the places that are read."""

    def __init__(self, w, at, tf, m, cuts, bounds):
        self.w, self.at, self.tf, self.m, self.cuts, self.bounds = w, at, tf, m, cuts, bounds

    def window(self, i):
        a, b = self.cuts[i], self.cuts[i + 1]
        at = self.at[a:b]
        return at, self.w * gain(self.tf[a:b].astype(np.int64), self.m[at])

    def at_docs(self, i, docs):
        a, b = self.cuts[i], self.cuts[i + 1]
        p = np.searchsorted(self.at[a:b], docs) + a
        hit = np.flatnonzero(p < b)
        hit = hit[self.at[p[hit]] == docs[hit]]
        return hit, self.w * gain(self.tf[p[hit]].astype(np.int64), self.m[docs[hit]])


class Accumulators:
    """The sum of the short lists, as one list."""

    def __init__(self, lists, windows):
        self.at, inverse = np.unique(np.concatenate([x[0] for x in lists]), return_inverse=True)
        self.score = np.zeros(len(self.at), np.int64)
        np.add.at(self.score, inverse, np.concatenate([x[1] for x in lists]))
        self.cuts = np.searchsorted(self.at, np.arange(windows + 1) * WINDOW)
        self.bounds = np.zeros(windows, np.int64)
        np.maximum.at(self.bounds, self.at // WINDOW, self.score)

    def window(self, i):
        mine = slice(self.cuts[i], self.cuts[i + 1])
        return self.at[mine], self.score[mine]

    def at_docs(self, i, docs):
        a, b = self.cuts[i], self.cuts[i + 1]
        p = np.searchsorted(self.at[a:b], docs) + a
        hit = np.flatnonzero(p < b)
        hit = hit[self.at[p[hit]] == docs[hit]]
        return hit, self.score[p[hit]]


class Best:
    """The k best (score, id) of a query so far; ``floor`` is what a further document must reach."""

    def __init__(self, k):
        self.k, self.rows, self.floor = k, [], 1

    def add(self, scores: np.ndarray, docs: np.ndarray, ids: list):
        if len(scores) > self.k:  # all that tie with the k-th stay, the ids decide
            keep = np.flatnonzero(scores >= np.partition(scores, -self.k)[-self.k])
            scores, docs = scores[keep], docs[keep]
        self.rows += [(-int(s), ids[d] is None, ids[d]) for s, d in zip(scores, docs)]
        self.rows.sort(key=lambda r: r if not r[1] else (r[0], True, 0))
        del self.rows[self.k:]
        if len(self.rows) == self.k:
            self.floor = -self.rows[-1][0]


def search_segment(seg: Segment, terms: list[bytes], best: Best) -> int:
    """Feed ``best`` with a query's documents of a segment; returns the number of windows visited."""
    short = [seg.short[t] for t in terms if t in seg.short]
    lists = [seg.long[t] for t in terms if t in seg.long]
    if short:
        lists.append(Accumulators(short, seg.windows))
    if not lists:
        return 0
    bounds, visited = np.array([x.bounds for x in lists]), 0
    reach = bounds.sum(0)
    for i in np.flatnonzero(reach):
        if reach[i] < best.floor:
            continue
        visited += 1
        order = np.argsort(bounds[:, i], kind="stable")
        upto = np.cumsum(bounds[order, i])
        first = int(np.searchsorted(upto, best.floor))  # the lists before this one cannot reach the floor together
        base, part = i * WINDOW, np.zeros(WINDOW, np.int64)
        for j in order[first:]:
            at, score = lists[j].window(i)
            part[at - base] += score
        docs = np.flatnonzero(part) + base
        for r in range(first - 1, -1, -1):
            docs = docs[part[docs - base] + upto[r] >= best.floor]
            if not len(docs):
                break
            hit, score = lists[order[r]].at_docs(i, docs)
            part[docs[hit] - base] += score
        docs = docs[part[docs - base] >= best.floor]
        if len(docs):
            best.add(part[docs - base], docs, seg.ids)
    return visited


def _lengths(numbers: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts in zip(batch.column("terms"), batch.column("starts")):
                size = np.diff(np.frombuffer(starts.as_py(), np.int64))
                got = [(numbers[t], size[i]) for i, t in enumerate(terms.as_py().split(b" ")) if t in numbers]
                if got:
                    term, df = zip(*got)
                    yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(df, pa.int64())], names=["term", "df"])
    return run


def _searcher(queries: list[list[bytes]], weights: dict[bytes, int], docs: int, words: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = [Best(top) for _ in queries], None
        for batch in batches:
            kind = batch.column("ids").type.value_type
            for i in range(batch.num_rows):
                seg = Segment(batch.slice(i, 1).to_pylist()[0], weights, docs, words)
                for terms, b in zip(queries, best):
                    search_segment(seg, terms, b)
        rows = [(q, r) for q, b in enumerate(best) for r in b.rows]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], pa.int32()), pa.array([r[2] for _, r in rows], kind),
                                              pa.array([-r[0] for _, r in rows], pa.int64())], names=["item", "doc_id", "score"])
    return run


def _blocks(queries: DataFrame, block_items: int, block_bytes: int) -> tuple[DataFrame, int]:
    """``queries`` with a column ``block`` whose blocks hold the given items and bytes, or one item, and their number."""
    rows, size = queries.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    n = max(1, math.ceil(rows / block_items), math.ceil((size or 0) / block_bytes))
    while True:
        dealt = queries.withColumn("block", F.pmod(F.xxhash64("item_id", "t"), F.lit(n)))
        over = dealt.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("size"))
        if n == 1 or not over.filter((F.col("n") > 1) & ((F.col("n") > 2 * block_items) | (F.col("size") > 2 * block_bytes))).head(1):
            return dealt, n
        n *= 2


def search(index: DataFrame, queries: DataFrame, item_id: str = "item_id", text: str = "text", top: int = TOP,
           block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's ``top`` documents with a score above 0."""
    spark = index.sparkSession
    kind = index.schema["ids"].dataType.elementType.simpleString()
    asked = checkpoint(pick(queries, item_id=item_id, t=text).filter("t IS NOT NULL").distinct())
    id_kind = asked.schema["item_id"].dataType.simpleString()
    docs, words = (int(x or 0) for x in index.agg(F.sum("docs"), F.sum("words")).first())
    dealt, n = _blocks(asked, block_items, block_bytes)
    out = spark.createDataFrame([], f"item_id {id_kind}, rank int, doc_id {kind}, score bigint")
    for b in range(n):
        items = [(r.item_id, sorted(set(terms_of(r.t)))) for r in dealt.filter(F.col("block") == b).select("item_id", "t").toLocalIterator()]
        items = [x for x in items if x[1]]
        if not items or not docs:
            continue
        vocabulary = sorted({t for _, terms in items for t in terms})
        counts = index.select("terms", "starts").mapInArrow(_lengths({t: i for i, t in enumerate(vocabulary)}), "term int, df bigint")
        weights = {vocabulary[r.term]: weight(docs, r.df) for r in counts.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        found = index.mapInArrow(_searcher([terms for _, terms in items], weights, docs, words, top), f"item int, doc_id {kind}, score bigint")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(i, x[0]) for i, x in enumerate(items)], f"item int, item_id {id_kind}")
        out = out.unionByName(checkpoint(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")))
    return out


def ranked_search(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", top: int = TOP) -> DataFrame:
    """``search`` over an index of ``docs`` that is written to the shared folder and removed again."""
    spark = docs.sparkSession
    path = shared_path(spark, f"lexical-{uuid4().hex}")
    try:
        build_index(docs, doc_id, text).write.option("compression", "zstd").parquet(path)
        return search(spark.read.parquet(path), queries, item_id, item_text, top)
    finally:
        remove_path(spark, path)
