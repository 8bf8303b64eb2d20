"""Reproducible pseudo-random draws as column expressions.

A draw is a pure function of (seed, row key, draw name): the md5 of
``"<seed>:<key>:<name>"``. Each md5 gives four independent 32-bit words, so
one hash feeds up to four decisions. Because nothing depends on partitioning,
task order or retries, a lost executor recomputes exactly the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reqsight.fixed import DEFAULT_SEED

TWO_32 = 4294967296.0


def draw_hex(key: Column | str, name: str, seed: int = DEFAULT_SEED) -> Column:
    """32 hex digits = four 32-bit draw words."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(name)))


def word(hex_col: Column | str, k: int = 0) -> Column:
    """Unsigned 32-bit integer from word ``k`` (0..3) of a draw hash."""
    hex_col = F.col(hex_col) if isinstance(hex_col, str) else hex_col
    return F.conv(F.substring(hex_col, 1 + 8 * k, 8), 16, 10).cast("bigint")


def unit(hex_col: Column | str, k: int = 0) -> Column:
    """Uniform double in [0, 1) from word ``k`` of a draw hash."""
    return word(hex_col, k) / F.lit(TWO_32)


def draw(key: Column | str, name: str, seed: int = DEFAULT_SEED) -> Column:
    """First 32 bits of the draw hash as a BIGINT (the common ``draw(id,name)``)."""
    return word(draw_hex(key, name, seed), 0)


def wide_draw(key: Column | str, name: str, seed: int = DEFAULT_SEED) -> Column:
    """60 bits of the draw hash as a BIGINT: for picks (``% n``) among any number of rows."""
    return F.conv(F.substring(draw_hex(key, name, seed), 1, 15), 16, 10).cast("bigint")


def choice(options: list[str], w: Column) -> Column:
    """``random.choice(options)`` driven by a draw word."""
    return F.element_at(F.array(*[F.lit(o) for o in options]),
                        (w % F.lit(len(options)) + 1).cast("int"))


def random_string(alphabet: str, words: list[Column]) -> Column:
    """One character of ``alphabet`` per draw word."""
    n = len(alphabet)
    return F.concat(*[F.substring(F.lit(alphabet), (w % F.lit(n) + 1).cast("int"), 1)
                      for w in words])
