"""Weak-labelling rules (L1-L6) as Catalyst expressions.

Every rule is an ordered first-match chain of ``contains`` tests generated
from the fixed rule lists, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from reqsight.fixed import (CLASSES, CLEAN_ORDER, CLEAN_STRIP, PAYLOAD_DEFAULT,
                            PAYLOAD_RULES, TITLE_RULES)


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def first_match(lowered: Column, rules, default: Column | str | None) -> Column:
    """CASE WHEN lowered contains any of rule 1 THEN class 1 WHEN ... ELSE default."""
    expr = None
    for cls, keywords in rules:
        cond = reduce(lambda a, b: a | b, [lowered.contains(k) for k in keywords])
        expr = F.when(cond, F.lit(cls)) if expr is None else expr.when(cond, F.lit(cls))
    if default is None:
        default = F.lit(None).cast("string")
    elif isinstance(default, str):
        default = F.lit(default)
    return expr.otherwise(default)


def class_from_title(title, lowered: bool = False) -> Column:
    """L1: class named by the title, or NULL."""
    t = _col(title)
    return first_match(t if lowered else F.lower(t), TITLE_RULES, None)


def class_from_payload(payload, default: str | None = PAYLOAD_DEFAULT,
                       lowered: bool = False) -> Column:
    """L2: class from payload keywords; ``default`` when no rule hits."""
    p = _col(payload)
    return first_match(p if lowered else F.lower(p), PAYLOAD_RULES, default)


def categorize(title, payload, lowered: bool = False) -> Column:
    """L3: title rules first, payload rules when the title says nothing."""
    return F.coalesce(class_from_title(title, lowered), class_from_payload(payload, lowered=lowered))


def clean_label(raw, strict: bool = False) -> Column:
    """Free-form label text to a class.

    NULL -> normal; otherwise strip ``[]"' `` and lower, take the first class
    (normal excluded) contained in it; else ``other`` for a non-empty original
    and ``normal`` for an empty one. ``strict`` maps a cleaned ``normal`` to
    ``normal`` instead of ``other``.
    """
    r = _col(raw)
    cleaned = F.lower(F.btrim(r, F.lit(CLEAN_STRIP)))
    expr = F.when(r.isNull(), F.lit("normal"))
    if strict:
        expr = expr.when(cleaned == F.lit("normal"), F.lit("normal"))
    for c in CLEAN_ORDER:
        expr = expr.when(cleaned.contains(c), F.lit(c))
    return expr.when(r != F.lit(""), F.lit("other")).otherwise(F.lit("normal"))


def classes_array() -> Column:
    return F.array(*[F.lit(c) for c in CLASSES])


def label_id(name) -> Column:
    """Class name -> id (NULL for an unknown name)."""
    pos = F.array_position(classes_array(), _col(name))
    return F.when(pos > 0, (pos - 1).cast("int"))


def label_name(idx) -> Column:
    """Class id -> name (NULL outside 0..7)."""
    i = _col(idx)
    return F.when(i.between(0, len(CLASSES) - 1), F.element_at(classes_array(), (i + 1).cast("int")))


def rule_scorer(payload) -> Column:
    """Stand-in scorer built only from payload rules: no hit means ``normal``.

    The payload is lower-cased once, not for every keyword, also where Spark shares no subexpressions (inside a lambda).
    """
    lowered = F.array(F.lower(_col(payload)))
    return F.coalesce(F.transform(lowered, lambda t: class_from_payload(t, default=None, lowered=True))[0], F.lit("normal"))
