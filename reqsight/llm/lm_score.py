"""LM scoring: stupid-backoff bigram scores, computed relationally.

S(w | c) = n(c, w) / n(c) if the bigram (c, w) occurs at least ``MIN_COUNT`` times in the corpus, else
``ALPHA`` * n(w) / N. A document's first word has the start mark as its context, which occurs once for each row
with words. The result is the sum of ln S over a document's words and its mean.

Word counts are one table keyed by the word's 64-bit hash. Bigrams, counted once for each document, are exploded into
rows (doc, bigram, word, times) dealt out by the bigram's 64-bit hash, so even the contexts of the most frequent words
spread over all tasks; counts and rows of a bigram meet in one partition and are joined there by a window. The word
count that a row then needs (of its context, or after backing off of the word itself) comes from a broadcast of the
``HEAVY_WORDS`` most frequent words, a fixed number, and from a join with the count table for all others.

Frequent bigrams make a large part of the rows and need not be shuffled. While words are counted, each task also names
the bigrams that are frequent among its own; the ``FREQUENT`` most frequent of these, a fixed number, are candidates.
One more pass counts the candidates over the whole corpus, summed before the shuffle. Their exact scores are broadcast,
and a document's occurrences of them become one row with their sum. Any choice of candidates gives the same results.

A bigram held by very many documents must not meet in one partition, whether a candidate or not. While words are counted,
each task also counts its bigram rows by hash in ``16 * shares`` bins, where ``shares`` is the number of shuffle
partitions, ``SHARES`` at least. Bins of more than one share of all rows, fewer than ``shares`` of them, are looked into
by the pass that counts the candidates. The bigrams that really have more than one share of the rows, again fewer than
``shares``, join the frequent ones.

The bigram table is built in ``SLICES`` slices of its hash, one after the other. Each slice ends in a written table of
sums per document and gives its shuffle files back, so the disk holds a fraction of the exploded corpus at a time.

Words are the runs without ASCII white space after A-Z is lower-cased, hashed for ``CHUNK`` bytes of texts at a time.
Defined results: rows that share an id are parts of one document (two equal rows have the mean of one); null ids share
one result; null and empty texts have no words, sum 0 and a null mean; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from reqsight.llm.common import by_value, checkpoint, pick
from reqsight.session import shared_path

by_value(__name__)

ALPHA = 0.4
MIN_COUNT = 2
SLICES = 3
HEAVY_WORDS = 50_000
FREQUENT = 100_000
FREQUENT_SHARE = 1e-6  # of a task's words, and CANDIDATE occurrences at least
CANDIDATE = 4
SHARES = 256
CHUNK = 1 << 20
FLUSH = 1 << 22  # words that are counted together
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
START = 0x5BD1E995  # the start mark's hash
TURN = 17  # bits by which a word's hash is turned in its bigrams' hashes
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
FOLD = np.frombuffer(bytes(range(256)).lower(), np.uint8)
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of some texts that lie one after the other, and the number of words of each text."""
    offsets = offsets - offsets[0]
    size = int(offsets[-1])
    if not size:
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    low = np.zeros(size + 16, np.uint8)
    np.take(FOLD, data, out=low[:size])
    space = SPACE[data]
    cuts = offsets[(offsets > 0) & (offsets < size)]  # a word ends with its text
    begins, ends = ~space, ~space
    begins[1:] &= space[:-1]
    begins[cuts] = ~space[cuts]
    ends[:-1] &= space[1:]
    ends[cuts - 1] = ~space[cuts - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = ends - begins
    eight = np.ndarray(size + 9, "<u8", low.data, strides=(1,))
    h = mix((eight[begins] & FIRST_BYTES[np.minimum(long, 8)]) ^ (long.astype(np.uint64) * ODD))
    more = np.flatnonzero(long > 8)
    second = eight[begins[more] + 8] & FIRST_BYTES[np.minimum(long[more] - 8, 8)]
    h[more] = mix(h[more] + second * np.uint64(0xC2B2AE3D27D4EB4F))
    more = more[long[more] > 16]
    if len(more):
        text = low.tobytes()
        words = (text[b:e] for b, e in zip(begins[more].tolist(), ends[more].tolist()))
        h[more] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(more))
    return h, np.diff(np.searchsorted(begins, offsets))


def word_hashes(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return hashed_words(data, np.array([0, len(data)]))[0]


def pair(c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The hash of a bigram of hashed words. With w it gives c back, see ``context``."""
    return c ^ (w << np.uint64(TURN) | w >> np.uint64(64 - TURN))


def context(g: str, w: str):
    return F.col(g).bitwiseXOR(F.shiftleft(w, TURN).bitwiseOR(F.shiftrightunsigned(w, 64 - TURN)))


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, number of words, text, word, bigram) of about ``CHUNK`` bytes of texts at a time: ``first`` is the place of the
    chunk's first text in the column, the last three have an entry for each word, texts by their places in the chunk."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        h, n = hashed_words(data[offsets[first]:offsets[last]], offsets[first:last + 1])
        if len(h):
            c = np.empty_like(h)
            c[1:] = h[:-1]
            c[(np.cumsum(n) - n)[n > 0]] = START
            yield first, n, np.repeat(np.arange(len(n)), n), h, pair(c, h)
        first = last


def bins(g: np.ndarray, n: int) -> np.ndarray:
    """The bin of a bigram's hash; other bits than those that pick its slice."""
    return ((g >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts x, the places in it where another value begins, and how often each value occurs."""
    order = np.argsort(x)
    x = x[order]
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return order, at, np.diff(at, append=len(x))


def distinct(text: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the distinct bigrams of each text stand, and how often they occur in it."""
    order, at, times = runs(g + text.astype(np.uint64) * ODD)
    return order[at], times


class Known:
    """A fixed set of bigram hashes with values, looked up for many bigrams at a time."""

    def __init__(self, g: np.ndarray, values: np.ndarray | None = None):
        order = np.argsort(g)
        self.g, self.values = g[order], None if values is None else values[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[g >> np.uint64(44)] = True

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the known ones stand among the given ones, and their places in this set."""
        at = np.flatnonzero(self.maybe[g >> np.uint64(44)])
        place = np.searchsorted(self.g, g[at])
        found = self.g[np.minimum(place, len(self.g) - 1)] == g[at] if len(self.g) else np.zeros(len(at), bool)
        return at[found], place[found]


def _count(n_bins: int):
    """Counts of words (w, n, false) and of frequent bigrams (hash, n, null) for each few batches, and of bigram rows by
    bin (bin, n, true) for each task."""
    def out(w, n, binned):
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64)), pa.array([binned], pa.bool_()).take(pa.array(np.zeros(len(w), np.int32)))],
                                          names=["w", "n", "binned"])

    def counted(words, grams, texts):
        w, n = np.unique(np.concatenate([*words, np.full(texts, START, np.uint64)]), return_counts=True)
        yield out(w, n, False)
        g, n = np.unique(np.concatenate(grams), return_counts=True)
        often = np.flatnonzero(n >= max(CANDIDATE, FREQUENT_SHARE * n.sum()))
        if len(often):
            yield out(g[often], n[often], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(n_bins, np.int64)
        words, grams, texts, held = [], [], 0, 0
        for batch in batches:
            for _, n, text, h, g in chunks(batch.column("t")):
                filled += np.bincount(bins(g[distinct(text, g)[0]], n_bins), minlength=n_bins)
                words.append(h)
                grams.append(g)
                texts += np.count_nonzero(n)
                held += len(h)
                if held >= FLUSH:
                    yield from counted(words, grams, texts)
                    words, grams, texts, held = [], [], 0, 0
        if held:
            yield from counted(words, grams, texts)
        at = np.flatnonzero(filled)
        if len(at):
            yield out(at, filled[at], True)
    return run


def _count_in_bins(n_bins: int, hot: list[int], also: np.ndarray):
    """(c, w, n, rows, also): occurrences of the bigrams of some bins, and of those in ``also``, and the rows that they make,
    summed for each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known = np.zeros(n_bins, bool), Known(also)
        wanted[hot] = True
        for batch in batches:
            found = []
            for _, _, text, h, g in chunks(batch.column("t")):
                asked = np.zeros(len(g), bool)
                asked[known.find(g)[0]] = True
                mine = np.flatnonzero(wanted[bins(g, n_bins)] | asked)
                at, times = distinct(text[mine], g[mine])
                at = mine[at]
                found.append((g[at], h[at], times, asked[at]))
            if found:
                g, w, times, asked = (np.concatenate(x) for x in zip(*found))
                order, at, rows = runs(g)
                if len(at):
                    n = np.add.reduceat(times[order], at)
                    g, w, asked = (x[order[at]] for x in (g, w, asked))
                    c = pair(g, w)  # undoes itself
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(w.view(np.int64)), pa.array(n), pa.array(rows), pa.array(asked)],
                                                     names=["c", "w", "n", "rows", "also"])
    return run


def _explode(slices: int, part: int, known):
    """(doc_id, g, w, times, own): the distinct bigrams of each text that fall into one slice of their hash; those that are known
    are one row of a text, with their sum of ln S as ``own``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Known(*known.value)
        for batch in batches:
            for first, n, text, h, g in chunks(batch.column("t")):
                mine = np.flatnonzero(g % np.uint64(slices) == part)
                at, place = table.find(g[mine])
                of = text[mine[at]]
                words = np.bincount(of, minlength=len(n))
                own = np.bincount(of, table.values[place], minlength=len(n))
                summed = np.flatnonzero(words)
                mine = np.delete(mine, at)
                at, times = distinct(text[mine], g[mine])
                at = mine[at]
                # the key of a sum is of no use but to deal the sums out
                key = mix(summed.astype(np.uint64) + g[(np.cumsum(n) - n)[summed]])
                rows = np.concatenate([text[at], summed]) + first
                no_own = np.concatenate([np.ones(len(at), bool), np.zeros(len(summed), bool)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows)), pa.array(np.concatenate([g[at], key]).view(np.int64)),
                     pa.array(np.concatenate([h[at], key]).view(np.int64)), pa.array(np.concatenate([times, words[summed]]).astype(np.int32)),
                     pa.array(np.concatenate([np.zeros(len(at)), own[summed]]), mask=no_own)], names=["doc_id", "g", "w", "times", "own"])
    return run


def hot_bigrams(rows: DataFrame, binned: DataFrame, shares: int, also: np.ndarray | None = None) -> DataFrame | None:
    """(c, w, hot_n, salts) of the bigrams that have more than one of ``shares`` equal shares of all bigram rows, ``salts`` shares,
    and of those whose hashes are in ``also``."""
    share = (binned.agg(F.sum("n")).first()[0] or 0) / shares
    hot = [r.w for r in binned.filter(F.col("n") > share).select("w").collect()]  # fewer than shares numbers
    also = np.empty(0, np.uint64) if also is None else also
    if not hot and not len(also):
        return None
    sums = rows.select("t").mapInArrow(_count_in_bins(16 * shares, hot, also), "c bigint, w bigint, n bigint, rows bigint, also boolean")
    sums = sums.groupBy("c", "w").agg(F.sum("n").alias("hot_n"), F.sum("rows").alias("rows"), F.max("also").alias("also"))
    sums = sums.filter(F.col("also") | (F.col("rows") > share))
    return checkpoint(sums.select("c", "w", "hot_n", F.ceil(F.col("rows") / share).cast("bigint").alias("salts")))


def frequent_scores(rows: DataFrame, counted: DataFrame, words: DataFrame, shares: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the frequent and the hot bigrams, at most ``FREQUENT`` + ``shares``, and ln S of each."""
    candidates = counted.filter("binned IS NULL").orderBy(F.col("n").desc(), "w").limit(FREQUENT).select("w").toArrow()
    met = hot_bigrams(rows, counted.filter("binned"), shares, candidates["w"].to_numpy().view(np.uint64))
    if met is None:
        return np.empty(0, np.uint64), np.empty(0)
    met = met.filter(F.col("hot_n") >= MIN_COUNT)
    met = words.select(F.col("w").alias("u"), "ln").join(F.broadcast(met), F.col("u") == F.col("c"))
    met = met.select("c", "w", (F.log(F.col("hot_n").cast("double")) - F.col("ln")).alias("own")).toArrow()
    c, w = (met[x].to_numpy().view(np.uint64) for x in ("c", "w"))
    return pair(c, w), met["own"].to_numpy()


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slices: int = SLICES) -> DataFrame:
    """One row per distinct id: doc_id, n_words, log_prob (sum of ln S), score (its mean)."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id=doc_id, t=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    base = shared_path(spark, f"lm-{uuid4().hex}")
    shares = max(SHARES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.select("t").mapInArrow(_count(16 * shares), "w bigint, n bigint, binned boolean").groupBy("binned", "w").agg(
        F.log(F.sum("n").cast("double")).alias("ln"), F.sum("n").alias("n")).write.parquet(f"{base}/words")
    counted = spark.read.parquet(f"{base}/words")
    words = counted.filter("NOT binned").drop("binned")
    known = spark.sparkContext.broadcast(frequent_scores(rows, counted, words, shares))
    start = int(np.uint64(START).view(np.int64))
    total = words.filter(F.col("w") != start).agg(F.log(F.sum("n").cast("double"))).first()[0] or 0.0
    heavy = checkpoint(words.orderBy(F.col("n").desc(), "w").limit(HEAVY_WORDS).select(F.col("w").alias("h"), F.col("ln").alias("h_ln")))
    back_off = float(np.log(ALPHA)) - total
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # a slice's shuffle files go when its table is written
    try:
        for part in range(slices):
            grams = rows.mapInArrow(_explode(slices, part, known), f"doc_id {kind}, g bigint, w bigint, times int, own double")
            # one long as the key of the sort: Spark sorts it by radix
            met = grams.withColumn("n", F.sum("times").over(Window.partitionBy("g")))
            seen, summed = F.col("n") >= MIN_COUNT, F.col("own").isNotNull()
            need = met.select(
                "doc_id", "times", F.when(summed, F.lit(None)).when(seen, context("g", "w")).otherwise(F.col("w")).alias("k"),
                F.when(summed, 0).when(seen, -F.col("times")).otherwise(F.col("times")).alias("sign"), summed.alias("summed"),
                F.coalesce("own", F.col("times") * F.when(seen, F.log(F.col("n").cast("double"))).otherwise(F.lit(back_off))).alias("own"))
            got = need.join(F.broadcast(heavy), F.col("k") == F.col("h"), "left")
            rest = F.col("h").isNull() & ~F.col("summed")
            # rows already resolved become one row for each document here; the others keep the word they still need
            got = got.groupBy("doc_id", F.when(rest, F.col("k")).otherwise(F.xxhash64("doc_id")).alias("k"), rest.alias("rest")).agg(
                F.sum("times").alias("words"), F.sum("sign").alias("sign"),
                F.sum(F.col("own") + F.col("sign") * F.coalesce("h_ln", F.lit(0.0))).alias("lp"))
            got = got.join(words.select(F.col("w").alias("u"), "ln", F.lit(True).alias("u_rest")),
                           (F.col("k") == F.col("u")) & (F.col("rest") == F.col("u_rest")), "left")
            lp = F.col("lp") + F.when(F.col("rest"), F.col("sign") * F.col("ln")).otherwise(0.0)
            got.groupBy("doc_id").agg(F.sum("words").alias("words"), F.sum(lp).alias("lp")).write.parquet(f"{base}/slice={part}")
    finally:
        spark.conf.set(CLEANUP, before)
    sums = spark.read.option("basePath", base).parquet(*[f"{base}/slice={p}" for p in range(slices)])
    ids = rows.select("doc_id", F.lit(0).cast("bigint").alias("words"), F.lit(0.0).alias("lp"))
    out = sums.select("doc_id", "words", "lp").unionByName(ids).groupBy("doc_id").agg(F.sum("words").alias("n_words"), F.sum("lp").alias("log_prob"))
    return out.withColumn("score", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))
