"""Sampling, ordering and splitting (M1-M7) without single-partition windows.

All orderings are by a hash draw, which is uniform. Ranks come from a histogram of the draws' top
``RANK_BITS`` bits, taken in two levels, so neither ranking nor summing up the histogram ever puts more
than ``2^(RANK_BITS / 2)`` histogram rows or one bucket's rows into one window partition: a table of
10^12 rows has about a million rows per bucket. Caps and splits do not rank rows at all: the histogram
names the one bucket of a class that holds the cut, only that bucket is ranked, and every other row is
decided by comparing its draw with the cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from reqsight.fixed import CAP_PER_CLASS, DEFAULT_SEED, TEST_FRACTION
from reqsight.functions.draws import draw, unit, draw_hex, wide_draw
from reqsight.session import reliable_checkpoint

RANK_BITS = 20
SALTS = 256
#: Copies of one row that are written at a time.
LOT = 1 << 16


def _histogram(d: DataFrame, gcols: list[str], bits: int) -> DataFrame:
    """(group, _b) with _n rows, _off rows before the bucket and _size rows of the group; ``d`` has _b."""
    half = bits // 2
    hist = d.groupBy(*gcols, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_c", F.shiftright("_b", half))
    before = Window.unboundedPreceding, -1
    coarse = hist.groupBy(*gcols, "_c").agg(F.sum("_n").alias("_cn"))
    zero = F.lit(0).cast("bigint")
    coarse = (coarse.withColumn("_coff", F.coalesce(F.sum("_cn").over(Window.partitionBy(*gcols).orderBy("_c").rowsBetween(*before)), zero))
              .withColumn("_size", F.sum("_cn").over(Window.partitionBy(*gcols))).drop("_cn"))
    fine = F.coalesce(F.sum("_n").over(Window.partitionBy(*gcols, "_c").orderBy("_b").rowsBetween(*before)), zero)
    keys = [F.col(f"h.{g}").eqNullSafe(F.col(f"c.{g}")) for g in gcols] + [F.col("h._c") == F.col("c._c")]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    return (hist.withColumn("_fine", fine).alias("h").join(coarse.alias("c"), on)
            .select(*[F.col(f"h.{g}").alias(g) for g in gcols], "_b", "_n", (F.col("_fine") + F.col("_coff")).alias("_off"), "_size"))


def dense_index(df: DataFrame, order: Column, key: str, group: str | None = None,
                out: str = "idx", bits: int = RANK_BITS, size_col: str | None = None) -> DataFrame:
    """Add ``out``: the 0-based rank of each row within ``group`` by (order, key).

    ``order`` must be a uniform 32-bit draw (BIGINT in [0, 2^32)) of a unique row ``key``.
    """
    gcols = [group] if group else []
    d = df.withColumn("_d", order).withColumn("_b", F.shiftright(F.col("_d"), 32 - bits))
    hist = _histogram(d, gcols, bits).drop("_n")
    hist = hist.withColumnRenamed("_size", size_col) if size_col else hist.drop("_size")
    w_in = Window.partitionBy(*gcols, "_b").orderBy("_d", key)
    return (d.join(hist, gcols + ["_b"])
            .withColumn(out, (F.col("_off") + F.row_number().over(w_in) - 1).cast("bigint"))
            .drop("_d", "_b", "_off"))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed: orders rows that repeat a key."""
    return F.xxhash64(*[F.col(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])


def class_cuts(df: DataFrame, label: str, key: str, order: Column, take: Callable[[Column], Column],
               bits: int = RANK_BITS) -> DataFrame:
    """Per class the place where its first ``take(size)`` rows end: ``_cl, _cut, _keep, _copies``; no row for a class that takes none.

    Rows are ordered by (order, key, row hash). Every row before ``_cut`` is taken and of the ``_copies`` equal rows
    at ``_cut`` the number ``_keep``. Equal rows are counted before the one bucket per class that holds the cut is ranked.
    """
    d = df.select(label, key, row_hash(df).alias("_h")).withColumn("_d", order).withColumn("_b", F.shiftright(F.col("_d"), 32 - bits))
    hist = _histogram(d, [label], bits).withColumn("_rest", take(F.col("_size")) - F.col("_off")).filter("_rest > 0")
    at = hist.groupBy(F.col(label).alias("_cl")).agg(F.max(F.struct("_b", "_rest", "_n")).alias("_at"))
    edge = d.join(F.broadcast(at), F.col(label).eqNullSafe(F.col("_cl")) & (F.col("_b") == F.col("_at._b")))  # one row per class
    edge = edge.groupBy("_cl", "_d", key, "_h", F.least("_at._rest", "_at._n").alias("_want")).agg(F.count(F.lit(1)).alias("_copies"))
    upto = F.sum("_copies").over(Window.partitionBy("_cl").orderBy("_d", key, "_h"))
    edge = edge.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_copies") < F.col("_want")))
    return edge.select("_cl", F.struct(F.col("_d"), F.col(key), F.col("_h")).alias("_cut"),
                       (F.col("_want") - F.col("_upto") + F.col("_copies")).alias("_keep"), "_copies")


def _first_rows(df: DataFrame, label: str, key: str, order: Column, cuts: DataFrame, how: str) -> DataFrame:
    """``df`` (joined with its class's cut as ``how`` says) with ``_first``: whether a row is among its class's first.

    Only where equal rows lie across a cut, these (one counted row per class) are taken out and written anew, some of them as first.
    """
    cuts = reliable_checkpoint(cuts)  # one row per class
    cols = df.columns
    place = F.struct(order.alias("_d"), F.col(key), row_hash(df).alias("_h"))
    marked = df.withColumn("_place", place).join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("_cl")), how)
    first = F.coalesce(F.col("_place") <= F.col("_cut"), F.lit(False))
    if not cuts.filter("_keep < _copies").head(1):
        return marked.select(*cols, first.alias("_first"))
    split = F.coalesce((F.col("_place") == F.col("_cut")) & (F.col("_keep") < F.col("_copies")), F.lit(False))
    one = marked.filter(split).groupBy("_cl").agg(F.first(F.struct(*cols)).alias("r"), F.first("_keep").alias("_keep"), F.first("_copies").alias("_copies"))
    lots = one.withColumn("_lot", F.explode(F.expr(f"sequence(0L, (_copies - 1) div {LOT})")))
    again = lots.withColumn("_no", F.explode(F.expr(f"sequence(_lot * {LOT} + 1, least((_lot + 1) * {LOT}, _copies))")))
    return marked.filter(~split).select(*cols, first.alias("_first")).unionByName(again.select("r.*", (F.col("_no") <= F.col("_keep")).alias("_first")))


def cap_per_class(df: DataFrame, label: str = "label", key: str = "id",
                  cap: int = CAP_PER_CLASS, seed: int = DEFAULT_SEED) -> DataFrame:
    """M1: at most ``cap`` rows per label, chosen by a seeded draw of a key; NULL labels drop out.

    Rows are kept or dropped where they are read: no shuffle but that of the histogram. Rows that repeat a key have one
    draw and are ordered by a hash of the row; of equal rows any may stay, and the number is exact.
    """
    order = draw(F.col(key), "cap", seed)
    known = df.filter(F.col(label).isNotNull())
    cuts = class_cuts(known, label, key, order, lambda n: F.least(n, F.lit(cap)))
    return _first_rows(known, label, key, order, cuts, "inner").filter("_first").select(*df.columns)


def random_split(df: DataFrame, key: str = "id", test: float = TEST_FRACTION,
                 seed: int = DEFAULT_SEED, group_col: str | None = None) -> DataFrame:
    """M2: seeded, unstratified; ``group_col`` keeps a whole group on one side."""
    u = unit(draw_hex(F.col(group_col or key), "split", seed))
    return df.withColumn("split", F.when(u < test, F.lit("test")).otherwise(F.lit("train")))


def stratified_split(df: DataFrame, label: str = "label", key: str = "id",
                     test: float = TEST_FRACTION, seed: int = DEFAULT_SEED) -> DataFrame:
    """M3: per class, the first round(test * n_class) rows in draw order are ``test``; a class of one row is an error.

    Like M1, rows are decided where they are read, and the numbers are exact for repeated keys too.
    """
    order = draw(F.col(key), "strat", seed)

    def take(n):
        k = F.round(n * F.lit(test)).cast("bigint")
        return F.when(n < 2, F.raise_error(F.lit("a class has fewer than 2 rows; cannot stratify")).cast("bigint")).otherwise(k)

    cuts = class_cuts(df, label, key, order, take)
    marked = _first_rows(df, label, key, order, cuts, "left")
    return marked.select(*df.columns, F.when(F.col("_first"), F.lit("test")).otherwise(F.lit("train")).alias("split"))


def shuffle_rows(df: DataFrame, key: str = "id", seed: int = DEFAULT_SEED, out: str = "row_index") -> DataFrame:
    """M4: a seeded random total order, exposed as a dense 0-based index."""
    return dense_index(df, draw(F.col(key), "shuffle", seed), key, out=out)


def sample_templates(draws: DataFrame, templates: DataFrame, draw_key: str = "id", template_key: str = "tid",
                     seed: int = DEFAULT_SEED) -> DataFrame:
    """M5: one draw with replacement from ``templates`` for each row of ``draws``.

    Templates are numbered by a distributed dense index; the number of templates is counted first.
    """
    n = templates.count()
    numbered = dense_index(templates, draw(F.col(template_key), "pos", seed), template_key, out="_pos")
    return draws.withColumn("_pos", wide_draw(F.col(draw_key), "pick", seed) % F.lit(n)).join(numbered, "_pos").drop("_pos")


def top_values(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """M6: the ``k`` most frequent values (ties by value)."""
    if col not in df.columns:
        raise KeyError(f"no column {col!r}; columns are {df.columns}")
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc_nulls_last(col)).limit(k))


def hard_negatives(scored: DataFrame, label: str = "label", pred: str = "pred",
                   confidence: str = "confidence", key: str = "id", min_conf: float = 0.0,
                   k: int | None = 100, normal_id: int = 0) -> DataFrame:
    """M7: true-normal rows predicted as an attack, most confident first."""
    d = scored.filter((F.col(label) == normal_id) & (F.col(pred) != normal_id)
                      & (F.col(confidence) >= min_conf))
    d = d.orderBy(F.desc(confidence), F.asc(key))
    return d.limit(k) if k is not None else d


def hard_negatives_per_class(scored: DataFrame, k: int, label: str = "label", pred: str = "pred",
                             confidence: str = "confidence", key: str = "id", min_conf: float = 0.0,
                             normal_id: int = 0) -> DataFrame:
    """M7 per predicted class: the ``k`` most confident true-normal rows predicted as each attack class.

    In two levels: the best ``k`` of each (class, salt), then the best ``k`` of what is left of a class
    (``SALTS`` x k rows at most), so a hot class never reaches one task whole, whatever k or the session's settings.
    """
    d = scored.filter((F.col(label) == normal_id) & (F.col(pred) != normal_id)
                      & (F.col(confidence) >= min_conf))
    best = [F.desc(confidence), F.asc(key)]
    d = d.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy(pred, "_salt").orderBy(*best))).filter(F.col("rank") <= k)
    return d.drop("_salt").withColumn("rank", F.row_number().over(Window.partitionBy(pred).orderBy(*best))).filter(F.col("rank") <= k)
