"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: each source's share of all words follows its weight, but stops at ``max_repeats`` times the source's own
words; the excess is shared again by weight until no source is above. Shares are kept as integer fractions, so every
engine and every rerun gets the same numbers.

Blocks: the documents of a source are shuffled by a hash of their id and laid end to end, again for each epoch, up to
the source's target. That line of words is cut into blocks of ``block`` words (the last one holds what is left). A
document's place on its line is a prefix sum in two levels, inside hash buckets and over buckets, so no source meets in
one task.

Schedule: slot k has the point (k * 0.381966... mod 1), the golden-ratio sequence in 32-bit integers. Cumulative
weights (blocks a source needs) cut the unit interval into one piece per source, and the point's piece names the slot's
source. The rank of a slot among its source's slots is the number of earlier points in that piece, which for this
sequence has a closed form (a sum of floors, by Euclid's algorithm): no sort and no window over the slots. Slots past a
source's last block fall away; the few blocks that the sequence leaves over follow at the end. ``mix`` joins the slots
with the blocks of the same source and rank.

Defined results: a word is a run without ASCII white space; null and empty texts have size 0 and are never taken; a null
source is a source of its own, last in order; rows that agree in id, source and size are copies that follow each other
on the line; null ids are ordered first; an empty table gives no rows; weights are integers, and a source of weight 0
takes nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from reqsight.llm.common import BROADCAST_ROWS, attach, by_value, checkpoint, pick

by_value(__name__)

BLOCK = 1024
MAX_REPEATS = 3
SEED = 42
PERIOD = 1 << 32
STEP = 1640531527  # the odd number nearest to PERIOD * (1 - 1 / golden ratio)
CELL = 1 << 20     # points of one look-up cell: 4,096 cells
#: A hash bucket of documents holds about this many rows at most; there are 4,096 buckets at least.
BUCKET_ROWS = 1 << 16
WIDE = "decimal(38,0)"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def cycling_weights(sources: DataFrame, weights: list[int]) -> DataFrame:
    """``weight`` by the order of ``source`` (code points, null last), repeating: one row per source passes one window."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(place, F.lit(len(weights)))).cast("bigint"))


def source_targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources`` (source_size, weight) with num and den: the target is num / den words."""
    s = checkpoint(sources.withColumn("cap", F.lit(max_repeats) * F.col("source_size")))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    used, weight = 0, s.agg(F.sum("weight")).first()[0] or 0

    def above(used, weight):
        return F.col("weight").cast(WIDE) * F.lit(total - used).cast(WIDE) > F.col("cap").cast(WIDE) * F.lit(weight).cast(WIDE)

    while weight:  # a source above its cap stays above: what is left for a unit of weight only grows
        r = s.agg(F.sum(F.when(above(used, weight), F.col("cap"))), F.sum(F.when(~above(used, weight), F.col("weight")))).first()
        now = (r[0] or 0, r[1] or 0)
        if now == (used, weight):
            break
        used, weight = now
    capped = above(used, weight) if weight else F.col("weight") > 0
    num = F.when(capped, F.col("cap")).otherwise(F.col("weight") * F.lit(total - used if weight else 0))
    return s.select(*sources.columns, num.cast("bigint").alias("num"), F.when(capped, F.lit(1)).otherwise(F.lit(weight or 1)).cast("bigint").alias("den"))


def floor_sum(n: np.ndarray, m: int, a: int, b: np.ndarray) -> np.ndarray:
    """Sum of floor((a * i + b) / m) over 0 <= i < n, modulo 2^64, for n < 2^32 and a, b, m <= 2^32."""
    n, b = n.astype(np.uint64), b.astype(np.uint64)
    out = np.zeros(n.shape, np.uint64)
    while True:
        out += n * (n - np.uint64(1)) // np.uint64(2) * np.uint64(a // m) + n * (b // np.uint64(m))
        a, b = a % m, b % np.uint64(m)
        top = np.uint64(a) * n + b
        if a == 0 or not top.any():
            return out
        n, b = top // np.uint64(m), top % np.uint64(m)
        m, a = a, m


def points_below(k: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many of the first k points lie below x (0 <= x <= PERIOD)."""
    k, x = np.asarray(k, np.int64), np.asarray(x, np.int64)
    n = k % PERIOD
    part = n.astype(np.uint64) + floor_sum(n, PERIOD, STEP, np.zeros_like(n)) - floor_sum(n, PERIOD, STEP, PERIOD - x)
    return k // PERIOD * x + part.astype(np.int64)


@F.pandas_udf(LongType())
def points_within(k: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
    """How many of the first k points lie in [lo, hi)."""
    return pd.Series(points_below(k, hi) - points_below(k, lo))


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, source_no, rank) for ``sources`` (source_no, blocks): each block of each source once, well mixed."""
    spark = sources.sparkSession
    s = sources.filter("blocks > 0").select("source_no", "blocks")
    total, kinds = s.agg(F.sum("blocks"), F.count("*")).first()
    total = int(total or 0)
    upto = F.sum("blocks").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1))
    edge = lambda c: F.floor(c.cast(WIDE) * F.lit(PERIOD).cast(WIDE) / F.lit(max(total, 1)).cast(WIDE)).cast("bigint")
    s = s.withColumn("before", F.coalesce(upto, F.lit(0)))
    s = checkpoint(s.select("source_no", "blocks", edge(F.col("before")).alias("lo"), edge(F.col("before") + F.col("blocks")).alias("hi")))
    cells = s.filter("lo < hi").withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {CELL}"), F.expr(f"(hi - 1) div {CELL}"))))
    if kinds <= BROADCAST_ROWS - PERIOD // CELL:
        cells = F.broadcast(cells)
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(total / (1 << 20)))
    slots = spark.range(0, total, 1, tasks).select(F.col("id").alias("slot"), F.expr(f"id % {PERIOD} * {STEP} % {PERIOD}").alias("point"))
    slots = slots.withColumn("at", F.expr(f"point div {CELL}"))
    named = slots.join(cells, (F.col("at") == F.col("cell")) & (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")))
    ranked = named.withColumn("rank", points_within("slot", "lo", "hi")).filter("rank < blocks").select("slot", "source_no", "rank")
    met = s.withColumn("met", points_within(F.lit(total).cast("bigint"), "lo", "hi")).filter("met < blocks")
    late = F.coalesce(F.sum(F.col("blocks") - F.col("met")).over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = met.withColumn("late", late).select("source_no", "met", "late", F.explode(F.sequence("met", F.col("blocks") - 1)).alias("rank"))
    return ranked.unionByName(left.select((F.lit(total) + F.col("late") + F.col("rank") - F.col("met")).alias("slot"), "source_no", "rank"))


class Mix:
    """The parts of a mixture: ``sources``, ``documents`` (one row per input row with its place) and ``rows()``."""

    def __init__(self, sources: DataFrame, documents: DataFrame, block: int):
        self.sources, self.documents, self.block = sources, documents, block

    def blocks(self) -> DataFrame:
        """(source_no, rank, doc_id, start, epoch, from_word, n_words): what each block holds."""
        size = F.col("source_size")
        d = self.documents.filter("size > 0 AND wanted > 0")
        d = d.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(wanted - 1) div source_size"))))
        d = d.withColumn("a", F.col("start") + F.col("epoch") * size).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("wanted")))
        n = F.lit(self.block)
        d = d.filter("a < b").withColumn("rank", F.explode(F.sequence(F.expr(f"a div {self.block}"), F.expr(f"(b - 1) div {self.block}"))))
        first = F.greatest(F.col("a"), F.col("rank") * n)
        return d.select("source_no", "rank", "doc_id", "start", "size", "epoch", (first - F.col("a")).alias("from_word"),
                        (F.least(F.col("b"), (F.col("rank") + 1) * n) - first).alias("n_words"))

    def rows(self) -> DataFrame:
        """The mixture: the blocks' pieces with the slot at which they are read (order by slot, then start)."""
        return schedule(self.sources).join(self.blocks(), ["source_no", "rank"])

    def taken(self) -> DataFrame:
        """One row per input row: doc_id, size, source_size, target, taken (words the mixture takes, repeats counted)."""
        key = ["source_no", "start", "doc_id", "size"]
        got = self.rows().select(*key, "n_words", F.lit(None).cast("bigint").alias("source_size"), F.lit(None).cast("double").alias("target"))
        all_rows = self.documents.select(*key, F.lit(0).cast("bigint").alias("n_words"), "source_size", "target")
        some = got.unionByName(all_rows.filter("size > 0")).groupBy(*key).agg(
            F.sum("n_words").alias("taken"), F.max("source_size").alias("source_size"), F.max("target").alias("target"))
        none = all_rows.filter("size = 0").withColumnRenamed("n_words", "taken")
        cols = ["doc_id", "size", "source_size", "target", "taken"]
        return some.select(*cols).unionByName(none.select(*cols))


def mix(docs: DataFrame, weights, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        max_repeats: int = MAX_REPEATS, block: int = BLOCK, seed: int = SEED) -> Mix:
    """The mixture of ``docs``. ``weights``: integers that repeat over the sources in order, or a function that adds
    a column ``weight`` to a frame of sources (source, source_size)."""
    kinds = pick(docs, source=source).schema["source"].dataType
    rows = pick(docs, doc_id=doc_id, t=text, source=source).select("doc_id", "source", n_words(F.col("t")).alias("size"))
    # rows that agree are counted here, so a repeated id is one row from now on
    rows = checkpoint(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies")))
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).cast("bigint").alias("source_size"), F.count("*").alias("weighs"))
    sources = weights(sources) if callable(weights) else cycling_weights(sources, list(weights))
    no = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("bigint")
    sources = source_targets(sources.withColumn("source_no", no), max_repeats)
    sources = checkpoint(sources.withColumn("wanted", F.expr("num div den")).withColumn("target", F.col("num") / F.col("den"))
                         .withColumn("blocks", F.expr(f"(wanted + {block - 1}) div {block}")))
    name = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    if kinds.simpleString() not in ("string", "int", "bigint"):
        raise ValueError("a source is a string or an integer")
    info = sources.select(name.alias("name"), "source_no", "source_size", "wanted", "target", "weighs")
    digits = max(3, math.ceil(math.log(max(rows.count(), 1) / BUCKET_ROWS, 16)))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = attach(rows.withColumn("name", name), info, "name", "weighs", "doc_id").withColumn("order", order)
    placed = placed.withColumn("bucket", F.substring("order", 1, digits)).withColumn("words", F.col("size") * F.col("copies"))
    inner = Window.partitionBy("source_no", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source_no", "bucket").agg(F.sum("words").alias("words"))
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(outer), F.lit(0)).alias("base"))
    lined = placed.withColumn("inside", F.coalesce(F.sum("words").over(inner), F.lit(0))).join(sums, ["source_no", "bucket"])
    # two steps, so that no array grows with the copies of one row
    lined = lined.withColumn("lot", F.explode(F.expr(f"sequence(0L, (copies - 1) div {BUCKET_ROWS})")))
    lined = lined.withColumn("copy", F.explode(F.expr(f"sequence(lot * {BUCKET_ROWS}, least((lot + 1) * {BUCKET_ROWS}, copies) - 1)")))
    documents = lined.select("doc_id", "size", "source_no", "source_size", "wanted", "target",
                             (F.col("base") + F.col("inside") + F.col("copy") * F.col("size")).alias("start"))
    return Mix(sources, checkpoint(documents), block)
