"""Small text helpers shared by the sources and payload functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Python's str.strip() white space: ASCII white space, \x1c-\x1f, \x85 and the
# Unicode separators (Zs, Zl, Zp). Spark's trim() strips only the space.
_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
WS_TRIM_PATTERN = f"^{_WS}+|{_WS}+$"


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(WS_TRIM_PATTERN), F.lit(""))


def split_first(c: Column, sep: str):
    """(before, after) around the first ``sep``; (NULL, c) when it is absent."""
    pos = F.locate(sep, c)
    before = F.when(pos > 0, c.substr(F.lit(1), pos - 1))
    after = F.when(pos > 0, c.substr(pos + len(sep), F.lit(1 << 30))).otherwise(c)
    return before, after
