"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reqsight.session import reliable_checkpoint

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Keys that may be broadcast as "heavy": a fixed number of rows, whatever the size of the input.
HEAVY_KEYS = 1024
#: A counted table of narrow rows up to this length is broadcast whole (a few MB).
BROADCAST_ROWS = 50_000
#: ``attach_counted`` broadcasts a table whole only if its values, written as JSON, have no more bytes in all.
BROADCAST_BYTES = 16 << 20
#: Shares into which ``attach_counted`` deals its rows, at least; a hot key takes as many as its part of the rows.
SHARES = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def by_value(module_name: str) -> None:
    """Ship a module's worker-side functions with the job, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` reduced to the named columns under new names.

    Columns are found by exact name (else by name in any case; of several equal names the first), so
    extra columns whose names differ only in case, repeat, or equal an operator's own names do no harm.
    """
    names, exact = df.columns, {}
    for i, n in reversed(list(enumerate(names))):
        exact[n] = i
    folded = {n.lower(): i for n, i in reversed(list(exact.items()))}
    flat = df.toDF(*[f"in_{i}" for i in range(len(names))])
    out = []
    for new, old in columns.items():
        i = exact.get(old, folded.get(old.lower()))
        if i is None:
            raise ValueError(f"no column {old} among {names}")
        out.append(F.col(f"in_{i}").alias(new))
    return flat.select(*out)


def with_columns(df: DataFrame, **columns: str) -> tuple[DataFrame, list[str]]:
    """``df`` with every column renamed to ``in_<i>`` plus copies of the named ones under new names.

    Returns the frame and the original names in order, for ``restore``.
    """
    names = df.columns
    flat = df.toDF(*[f"in_{i}" for i in range(len(names))])
    exact: dict[str, int] = {}
    for i, n in reversed(list(enumerate(names))):
        exact[n] = i
    folded = {n.lower(): i for n, i in reversed(list(exact.items()))}
    extra = {new: F.col(f"in_{exact.get(old, folded.get(old.lower()))}") for new, old in columns.items()}
    return flat.withColumns(extra), names


def restore(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns that ``with_columns`` renamed, under their first names."""
    return df.select(*[f"in_{i}" for i in range(len(names))]).toDF(*names)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def text_key(c: Column) -> Column:
    """SHA-256 of a text: equal texts, and only these, share it, crafted ones included."""
    return F.unhex(F.sha2(c, 256))


def attach(rows: DataFrame, table: DataFrame, key: str, weight: str, spread: str) -> DataFrame:
    """``rows`` left-joined with ``table`` (one row for each ``key``), safe against hot keys.

    ``table`` should be materialised: it is counted first. Up to ``BROADCAST_ROWS`` rows it is broadcast
    whole and ``rows`` do not move. Beyond that, the ``HEAVY_KEYS`` keys with the largest ``weight`` are
    broadcast, a fixed number of rows, so the rows of a hot key never meet in one task; all other keys go
    through an ordinary join. ``spread`` names a column of ``rows`` that deals out rows already resolved.
    The result holds the columns of ``rows`` and the non-key columns of ``table`` (null without match).
    """
    values = [c for c in table.columns if c != key]
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = table.select(F.col(key).alias("h_key"), *values)
        return rows.join(F.broadcast(small), F.col(key) == F.col("h_key"), "left").drop("h_key")
    heavy = table.orderBy(F.col(weight).desc(), F.col(key)).limit(HEAVY_KEYS)
    heavy = heavy.select(F.col(key).alias("h_key"), *[F.col(c).alias(f"h_{c}") for c in values])
    one = rows.join(F.broadcast(heavy), F.col(key) == F.col("h_key"), "left")
    # a resolved row must match nothing in the second join, and must not meet the others of its key
    one = one.withColumns({
        "j_salt": F.when(F.col("h_key").isNotNull(), F.pmod(F.xxhash64(F.col(spread)), F.lit(1 << 20)) + 1).otherwise(F.lit(0)),
        "j_key": F.col(key)})
    rest = table.select(F.col(key).alias("t_key"), F.lit(0).cast("bigint").alias("t_salt"), *[F.col(c).alias(f"t_{c}") for c in values])
    two = one.join(rest, (F.col("j_key") == F.col("t_key")) & (F.col("j_salt") == F.col("t_salt")), "left")
    return two.select(*rows.columns, *[F.coalesce(f"h_{c}", f"t_{c}").alias(c) for c in values])


def attach_counted(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """``attach`` for rows whose hot keys need not be in ``table``: heavy keys are those of the rows themselves.

    Up to ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` of ``table`` it is broadcast whole, so arrays of any length
    may be among its values. Beyond either, the rows are counted by key. A key that is among the ``HEAVY_KEYS``
    most frequent and has more than one of the ``SHARES`` equal shares of all rows is dealt out by ``spread`` to as
    many salts as it has shares, whether ``table`` holds it or not, and its row of ``table`` is repeated for each
    salt: at most ``SHARES`` + ``HEAVY_KEYS`` rows in all. Only keys and numbers of salts are broadcast.
    """
    values = [c for c in table.columns if c != key]
    written = F.octet_length(F.to_json(F.struct(*values))).cast("bigint")
    size = table.select(written.alias("bytes")).limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    if size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES:
        small = table.select(F.col(key).alias("h_key"), *values)
        return rows.join(F.broadcast(small), F.col(key) == F.col("h_key"), "left").drop("h_key")
    share = max(rows.count() / max(SHARES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1.0)
    heavy = rows.groupBy(F.col(key).alias("h_key")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "h_key").limit(HEAVY_KEYS)
    heavy = checkpoint(heavy.filter(F.col("n") > share).select("h_key", F.ceil(F.col("n") / share).cast("bigint").alias("h_salts")))
    salts = F.coalesce("h_salts", F.lit(1).cast("bigint"))
    one = rows.join(F.broadcast(heavy), F.col(key) == F.col("h_key"), "left").withColumn("j_salt", F.pmod(F.xxhash64(F.col(spread)), salts))
    rest = table.select(F.col(key).alias("t_key"), *[F.col(c).alias(f"t_{c}") for c in values])
    rest = rest.join(F.broadcast(heavy), F.col("t_key") == F.col("h_key"), "left")
    rest = rest.withColumn("t_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("h_key", "h_salts")
    two = one.join(rest, (F.col(key) == F.col("t_key")) & (F.col("j_salt") == F.col("t_salt")), "left")
    return two.select(*rows.columns, *[F.col(f"t_{c}").alias(c) for c in values])


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: computed once, lineage cut, safe if an executor is lost."""
    return reliable_checkpoint(df)
