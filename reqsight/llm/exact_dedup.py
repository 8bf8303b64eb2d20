"""Exact dedup by progressive refinement: length, then prefix hash, then full digest.

Rows whose length is unique are alone, and so are rows whose (length, prefix hash) is unique; the full
content of a text is hashed only for rows that survive both tests (for all rows if the caller asks for
every digest, as the contract's query does). Only (id, length, prefix hash, digest) is shuffled, counts
are summed on the map side, and hot groups are resolved by a broadcast of a fixed number of keys, so a
group that holds a third of all rows never meets in one task.

Defined results: a null text counts as an empty one; a null id is smaller than any other (a group of
null ids only has keep_id null and keeps one of its rows by ``drop_duplicates``); rows that repeat the
staying id inside one group are all marked kept by ``exact_groups``, and ``drop_duplicates`` leaves one
of them, the one with the smallest other columns; an empty table gives an empty result; extra columns
are ignored by ``exact_groups`` and kept by ``drop_duplicates``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from reqsight.llm.common import attach, checkpoint, pick, restore, with_columns

PREFIX_CHARS = 64


def _normal(c: Column, normalise: Callable[[Column], Column] | None) -> Column:
    c = F.coalesce(c, F.lit(""))
    return normalise(c) if normalise else c


def _repeated(rows: DataFrame) -> DataFrame:
    """(n, p) groups of at least two rows, looked for only among lengths of at least two rows."""
    lengths = rows.groupBy("n").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("n").alias("ln"))
    # counting (n, p) once gives both levels: a length is repeated if its groups sum to two or more
    pairs = rows.groupBy("n", "p").agg(F.count("*").alias("c")).filter("c > 1")
    return pairs.join(lengths, F.col("n") == F.col("ln"), "left_semi").select(
        F.struct("n", "p").alias("np"), F.col("c").alias("np_rows"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 normalise: Callable[[Column], Column] | None = None,
                 prefix_chars: int = PREFIX_CHARS, digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``text_sha256`` is null for rows that are alone by length or prefix, unless ``digest_all``.
    """
    t = _normal(F.col("t"), normalise)
    scan = pick(docs, doc_id=doc_id, t=text).withColumn("t", t)
    cols = ["doc_id", F.octet_length("t").alias("n"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("p")]
    if digest_all:
        rows = checkpoint(scan.select(*cols, F.sha2("t", 256).alias("sha")))
        rows = rows.withColumn("np", F.struct("n", "p"))
        flagged = attach(rows, checkpoint(_repeated(rows)), "np", "np_rows", "doc_id")
    else:
        rep = checkpoint(_repeated(scan.select(*cols)))
        rows = scan.select(*cols, "t").withColumn("np", F.struct("n", "p"))
        flagged = attach(rows, rep, "np", "np_rows", "doc_id").withColumn(
            "sha", F.when(F.col("np_rows").isNotNull(), F.sha2("t", 256))).drop("t")
    flagged = flagged.select("doc_id", "sha", F.when(F.col("np_rows").isNotNull(), F.col("sha")).alias("full"))
    if not digest_all:
        flagged = checkpoint(flagged)
    groups = checkpoint(flagged.filter("full IS NOT NULL").groupBy("full")
                        .agg(F.max("doc_id").alias("keep"), F.count("*").alias("size")).filter("size > 1"))
    out = attach(flagged.withColumn("full", F.coalesce("full", F.concat(F.lit("alone:"), F.xxhash64("doc_id", "sha")))),
                 groups, "full", "size", "doc_id")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
                      F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns."""
    groups = exact_groups(docs, doc_id, text, normalise)
    # only groups of two or more rows take part; the staying id and its digest name the row to keep
    losers = groups.filter("group_size > 1").select(
        F.struct("doc_id", "text_sha256").alias("k"), "kept").groupBy("k").agg(
        F.max("kept").alias("stay"), F.count("*").alias("copies"))
    losers = checkpoint(losers)
    flat, names = with_columns(docs, k_id=doc_id, k_text=text)
    sha = F.sha2(_normal(F.col("k_text"), normalise), 256)
    flat = flat.withColumn("k", F.struct(F.col("k_id").alias("doc_id"), sha.alias("text_sha256")))
    marked = attach(flat, losers, "k", "copies", "k_id")
    single = marked.filter("copies IS NULL OR (stay AND copies = 1)")
    data = [f"in_{i}" for i in range(len(names))]
    repeated = (marked.filter("stay AND copies > 1").groupBy("k")
                .agg(F.min(F.struct(*data)).alias("row")).select("row.*"))
    return restore(single.select(*data).unionByName(repeated), names)
