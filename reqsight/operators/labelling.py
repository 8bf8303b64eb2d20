"""Labelled samples (L4, U1) and the augmented dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from reqsight.fixed import AUGMENT_TARGET, DEFAULT_SEED
from reqsight.functions.augment import augment_payloads
from reqsight.functions.draws import draw, wide_draw
from reqsight.functions.rules import categorize, label_id
from reqsight.operators.sampling import dense_index
from reqsight.session import reliable_checkpoint


def label_lines(lines: DataFrame, title: str = "title", payload: str = "payload",
                is_attack=None) -> DataFrame:
    """L4: parsed lines -> samples ``text, label_str, label`` (other columns kept).

    ``is_attack`` is a column name, a boolean, or None (then the ``is_attack`` column).
    Lines of normal files never go through the rules.
    """
    if is_attack is None:
        attack = F.col("is_attack")
    elif isinstance(is_attack, bool):
        attack = F.lit(is_attack)
    else:
        attack = F.col(is_attack)
    # lower-case once in a sub-projection; the 39 contains tests reuse it
    d = lines.withColumn("_lt", F.lower(F.col(title))).withColumn("_lp", F.lower(F.col(payload)))
    lab = F.when(attack, categorize("_lt", "_lp", lowered=True)).otherwise(F.lit("normal"))
    d = d.withColumn("label_str", lab).drop("_lt", "_lp")
    return d.withColumn("text", F.col(payload)).withColumn("label", label_id("label_str"))


def split_empty_payloads(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(rows to score, rows answered ``ERROR`` without scoring) for empty or NULL payloads."""
    from reqsight.functions.payload import is_empty_payload
    empty = is_empty_payload(payload)
    return df.filter(~empty), df.filter(empty).withColumn("status", F.lit("ERROR"))


def hybrid_dataset(normal: DataFrame, attack: DataFrame) -> DataFrame:
    """Bag union of labelled normal and attack samples, duplicates kept."""
    return normal.unionByName(attack, allowMissingColumns=True)


def augment_dataset(spark: SparkSession, raw: DataFrame, key: str = "id",
                    target: int | None = None, seed: int = DEFAULT_SEED, factor: int | None = None) -> DataFrame:
    """All raw samples plus mutated draws from them up to ``target`` rows, or ``factor`` times the raw rows.

    ``raw`` needs ``key, text, label_str`` (+ optional ``tid``). It is written once to the shared folder and
    counted there. Synthetic row ``i`` picks a raw row by a 60-bit draw over a distributed dense index and
    mutates it with draws keyed by ``i``; integral ids continue after the largest raw id, other keys
    become strings and synthetic ids ``aug:<i>``. AQE broadcasts the raw side at run time when it is small
    and keeps a shuffle join otherwise. Columns: ``id, origin, src_id, tid, text, label_str, label``.
    """
    integral = isinstance(raw.schema[key].dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))
    keep_tid = "tid" in raw.columns
    base = reliable_checkpoint(raw.select(
        F.col(key).alias("src_id"), "text", "label_str", (F.col("tid") if keep_tid else F.lit(None).cast("int")).alias("tid")))
    n, top = base.agg(F.count(F.lit(1)), F.max("src_id")).first()
    if factor is not None:
        target = factor * n
    needed = max((AUGMENT_TARGET if target is None else target) - n, 0)
    kind = "bigint" if integral else "string"
    raw_rows = base.select(F.col("src_id").cast(kind).alias("id"), F.lit("raw").alias("origin"), "src_id", "tid", "text", "label_str")
    if needed == 0 or n == 0:
        return raw_rows.withColumn("label", label_id("label_str"))
    start = top + 1 if integral else n
    indexed = dense_index(base, draw(F.col("src_id"), "pos", seed), "src_id", out="_pos")
    picks = spark.range(start, start + needed).withColumn("_pos", wide_draw(F.col("id"), "pick", seed) % F.lit(n))
    synth = augment_payloads(picks.join(indexed, "_pos").drop("_pos"), "text", "label_str", "id", out="text", seed=seed)
    sid = F.col("id") if integral else F.concat(F.lit("aug:"), F.col("id").cast("string"))
    synth = synth.select(sid.cast(kind).alias("id"), F.lit("aug").alias("origin"), "src_id", "tid", "text", "label_str")
    return raw_rows.unionByName(synth).withColumn("label", label_id("label_str"))
