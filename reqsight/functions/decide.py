"""Scores to decisions (D1-D7) as array / struct expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reqsight.fixed import (OUTCOME_ALLOWED, OUTCOME_BLOCKED, STATUS_ATTACK, STATUS_ERROR,
                            STATUS_NORMAL)
from reqsight.functions.rules import label_name


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def softmax(logits) -> Column:
    """Numerically stable softmax of an ARRAY<DOUBLE>."""
    z = _col(logits)
    m = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0).cast("double"), lambda a, x: a + x)
    return F.transform(e, lambda x: x / s)


def log_sum_exp(logits) -> Column:
    z = _col(logits)
    m = F.array_max(z)
    return m + F.log(F.aggregate(F.transform(z, lambda x: F.exp(x - m)),
                                 F.lit(0.0).cast("double"), lambda a, x: a + x))


def argmax(logits) -> Column:
    """Index of the largest value, lowest index on ties."""
    z = _col(logits)
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def decide(logits) -> Column:
    """D3: STRUCT<pred INT, type STRING, confidence DOUBLE>."""
    p = softmax(logits)
    i = argmax(logits)
    return F.struct(i.alias("pred"), label_name(i).alias("type"),
                    F.element_at(p, i + 1).alias("confidence"))


def verdict_status(type_col, payload=None, on_error: str = STATUS_ATTACK) -> Column:
    """D5 status: NORMAL iff the class is normal; empty payload -> ERROR; class ``error`` -> on_error."""
    t = F.lower(_col(type_col))
    expr = F.when(F.lit(False), F.lit(None))
    if payload is not None:
        p = _col(payload)
        expr = F.when(p.isNull() | (p == F.lit("")), F.lit(STATUS_ERROR))
    return (expr.when(t == F.lit("error"), F.lit(on_error))
            .when(t == F.lit("normal"), F.lit(STATUS_NORMAL))
            .otherwise(F.lit(STATUS_ATTACK)))


def verdict(type_col, payload, on_error: str = STATUS_ATTACK) -> Column:
    """STRUCT<status, type, payload>; an ERROR row has no type."""
    st = verdict_status(type_col, payload, on_error)
    ty = F.when(st == F.lit(STATUS_ERROR), F.lit(None).cast("string")).otherwise(_col(type_col))
    return F.struct(st.alias("status"), ty.alias("type"), _col(payload).alias("payload"))


def api_record(type_col, confidence, model_name: str) -> Column:
    """STRUCT<is_attack, confidence, model, attack_type> (type upper-cased)."""
    t = _col(type_col)
    return F.struct((F.lower(t) != F.lit("normal")).alias("is_attack"),
                    _col(confidence).cast("double").alias("confidence"),
                    F.lit(model_name).alias("model"), F.upper(t).alias("attack_type"))


def outcome(status) -> Column:
    """BLOCKED for an ATTACK verdict, else ALLOWED."""
    return F.when(_col(status) == F.lit(STATUS_ATTACK), F.lit(OUTCOME_BLOCKED)).otherwise(
        F.lit(OUTCOME_ALLOWED))
