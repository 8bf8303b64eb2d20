"""Text encoders (E1, E2) as array expressions.

Truncation happens before splitting, so a 20,000-word text costs O(max_len).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reqsight.fixed import CHAR_PAD, CHAR_UNK, CLS_ID, MAX_LEN, PAD_ID, SEP_ID, UNK_ID


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def chars(text, n: int) -> Column:
    """The first ``n`` characters (code points) as ARRAY<STRING>."""
    head = F.substring(F.coalesce(_col(text), F.lit("")), 1, n)
    return F.filter(F.split(head, ""), lambda c: c != F.lit(""))


def encode_chars(text, max_len: int = MAX_LEN) -> Column:
    """ASCII char ids (chr(i) -> i + 1), others UNK 129, zero-padded to ``max_len``."""
    ids = F.transform(chars(text, max_len), lambda c: F.when(
        F.ascii(c) < 128, F.ascii(c) + 1).otherwise(F.lit(CHAR_UNK)))
    return F.concat(ids, F.array_repeat(F.lit(CHAR_PAD), F.lit(max_len) - F.size(ids)))


def vocab_map(vocab: dict[str, int]) -> Column:
    """Literal MAP of the single-character entries of a vocabulary (the only ones looked up)."""
    items = sorted((k, v) for k, v in vocab.items() if len(k) == 1)
    if not items:
        raise ValueError("vocabulary has no single-character entries")
    return F.create_map(*[x for k, v in items for x in (F.lit(k), F.lit(int(v)))])


def encode_cls_chars(text, vocab: dict[str, int], max_len: int = MAX_LEN) -> Column:
    """STRUCT<ids, mask>: CLS + up to max_len-2 lower-cased chars + SEP, zero-padded."""
    vm = vocab_map(vocab)
    cs = chars(F.lower(F.coalesce(_col(text), F.lit(""))), max_len - 2)
    body = F.transform(cs, lambda c: F.coalesce(F.element_at(vm, c), F.lit(UNK_ID)))
    n = F.size(body)
    ids = F.concat(F.array(F.lit(CLS_ID)), body, F.array(F.lit(SEP_ID)),
                   F.array_repeat(F.lit(PAD_ID), F.lit(max_len - 2) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n + 2), F.array_repeat(F.lit(0), F.lit(max_len - 2) - n))
    return F.struct(ids.alias("ids"), mask.alias("mask"))


# Our own demonstration vocabulary (no vocabulary ships with the reference):
# printable ASCII except the space, id = 1000 + code point.
DEMO_CHAR_VOCAB = {chr(i): 1000 + i for i in range(33, 127)}
