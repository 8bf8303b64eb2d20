"""Benchmark decontamination: normalised n-gram windows of the benchmark, looked up in every document.

The benchmark's windows of ``WINDOW`` consecutive words are hashed from their words' hashes; the distinct
hashes form the set that documents are scanned against, broadcast after a count proves it small and
joined by ``attach_counted`` beyond that, so a window that many documents hold meets in no one task.
Documents are exploded into window hashes with their place and the text's key only, no text; hits are
verified word by word against the benchmark's windows, from a second look at just the candidate texts
and places. The columns of a document's result depend on its text alone, so copies share one
verification and hot copies are resolved by ``attach_counted``. No step looks through a list for each
word or hit, so the work grows with a text's words, however many of them are hit.

Words are the runs of letters, digits and non-ASCII characters after A-Z is lower-cased. A window is
``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one window. Windows of
each length that the benchmark has are looked up.

Defined results: null or empty text has no words and no hits; repeated document rows are reported row by
row; an item_id that occurs on several rows counts once; null item_ids count as hits but not as items;
an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reqsight.functions.payload import bound
from reqsight.llm.common import ascii_lower, attach_counted, checkpoint, pick, restore, text_key, with_columns

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Distinct window hashes that may be broadcast: 8 bytes each, 16 MB.
MAX_BROADCAST_WINDOWS = 2_000_000


def words_of(text: Column) -> Column:
    """The words of a whole text (none for null)."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _window_hashes(hashes: Column, length: int) -> Column:
    """Hashes of all windows of ``length`` words, from the words' hashes, by start."""
    n = F.size(hashes)
    return F.when(n >= length, F.transform(
        F.sequence(F.lit(0), n - length),
        lambda i: F.xxhash64(F.lit(length), *[F.get(hashes, i + k) for k in range(length)])))


def _placed(hashes: Column, length: int) -> Column:
    return F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("pos"), F.lit(length).alias("length")))


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """(item_id, words, length, hash) of every distinct window of every item."""
    items = pick(benchmark, item_id=item_id, t=text).select("item_id", words_of(F.col("t")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    starts = items.withColumn("length", length).withColumn(
        "i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)))
    out = starts.select("item_id", "length", F.slice("w", F.col("i"), F.col("length")).alias("words"))
    hashed = F.transform("words", lambda x: F.xxhash64(x))
    case = F.lit(None).cast("bigint")
    for k in range(1, window + 1):
        case = F.when(F.col("length") == k, F.get(_window_hashes(F.col("wh"), k), F.lit(0))).otherwise(case)
    return out.withColumn("wh", hashed).select("item_id", "length", "words", case.alias("hash")).distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
              item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Verified results by text: key, hits (sorted word positions), items (sorted strings), n_copies.

    Only texts with a hit have a row.
    """
    wins = checkpoint(benchmark_windows(benchmark, item_id, item_text, window))
    lengths = sorted(r["length"] for r in wins.select("length").distinct().collect())  # at most `window` values
    scan = pick(docs, doc_id=doc_id, t=text).select("doc_id", text_key(F.coalesce("t", F.lit(""))).alias("key"), "t")
    hashed = scan.select("key", F.transform(words_of(F.col("t")), lambda x: F.xxhash64(x)).alias("wh"))
    places = [_placed(_window_hashes(F.col("wh"), k), k) for k in lengths] or [_placed(F.array().cast("array<bigint>"), 0)]
    grams = hashed.select("key", F.explode(F.flatten(F.array_compact(F.array(*places)))).alias("s")).select("key", "s.*")
    known = wins.select("hash").distinct()
    if known.limit(MAX_BROADCAST_WINDOWS + 1).count() <= MAX_BROADCAST_WINDOWS:
        met = grams.join(F.broadcast(known), "hash", "left_semi")
    else:
        met = attach_counted(grams, known.withColumn("known", F.lit(True)), "hash", "key").filter("known")
    # copies of a text have the same places, so a set holds each once
    cand = checkpoint(met.groupBy("key").agg(F.collect_set(F.struct("pos", "length")).alias("places")))
    # second look: only candidate texts, one row for each distinct text, the words at the candidate places
    texts = attach_counted(scan, cand, "key", "doc_id").filter("places IS NOT NULL")
    texts = texts.groupBy("key").agg(F.first("t").alias("t"), F.first("places").alias("places"), F.count("*").alias("n_copies"))
    texts = texts.select("key", "n_copies", "places", words_of(F.col("t")).alias("w"))
    at = texts.select("key", "n_copies", F.explode(F.transform("places", lambda s: F.struct(
        s["pos"].alias("pos"), s["length"].alias("length"),
        F.slice(F.col("w"), s["pos"] + 1, s["length"]).alias("words")))).alias("s")).select("key", "n_copies", "s.*")
    by_words = checkpoint(wins.groupBy("words").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids")))
    # the proof: equal words, not only equal hashes
    ok = attach_counted(at, by_words, "words", "key").filter("ids IS NOT NULL")
    return ok.groupBy("key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(
            F.sequence(F.col("pos"), F.col("pos") + F.col("length") - 1))))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"),
        F.first("n_copies").alias("n_copies"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, hits (word positions), items (item_ids as sorted strings)."""
    hits = checkpoint(find_hits(docs, benchmark, doc_id, text, item_id, item_text, window))
    rows = pick(docs, doc_id=doc_id, t=text).select(
        "doc_id", text_key(F.coalesce("t", F.lit(""))).alias("key"), F.size(words_of(F.col("t"))).cast("bigint").alias("n_words"))
    out = attach_counted(rows, hits, "key", "doc_id")
    return out.select("doc_id", "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def cut_words(text: Column, hits: Column) -> Column:
    """``text`` without the words at the given positions; what stands between words stays.

    Works on the text as written: A-Z only differ from a-z in the words, which keep their places.
    """
    any_case = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

    def cut(v):
        words, gaps = v["words"], v["gaps"]
        # (place, word) of all words, those of hits emptied, by place
        left = F.when(F.size(words) > 0, F.array_except(F.sequence(F.lit(0), F.size(words) - 1), hits)).otherwise(F.array().cast("array<int>"))
        by_place = F.array_sort(F.concat(
            F.transform(left, lambda i: F.struct(i.alias("i"), F.get(words, i).alias("w"))),
            F.transform(hits, lambda i: F.struct(i.alias("i"), F.lit("").alias("w")))))
        return F.array_join(F.zip_with(gaps, by_place, lambda g, p: F.concat(g, F.coalesce(p["w"], F.lit("")))), "")

    return bound(F.struct(F.regexp_extract_all(text, F.lit(any_case), F.lit(0)).alias("words"),
                          F.split(text, any_case, -1).alias("gaps")), cut)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents (mode ``documents``), or with the hit words cut out of them (``spans``)."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode {mode} is neither documents nor spans")
    hits = checkpoint(find_hits(docs, benchmark, doc_id, text, item_id, item_text, window))
    flat, names = with_columns(docs, k_text=text, k_id=doc_id)
    flat = flat.withColumn("key", text_key(F.coalesce("k_text", F.lit(""))))
    marked = attach_counted(flat, hits.select("key", "hits"), "key", "k_id")
    if mode == "documents":
        return restore(marked.filter("hits IS NULL"), names)
    at = f"in_{names.index(text)}"
    return restore(marked.withColumn(at, F.when(F.col("hits").isNull(), F.col(at)).otherwise(
        cut_words(F.col(at), F.col("hits")))), names)
