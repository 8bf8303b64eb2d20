"""Hashed character n-grams (E4) of many texts at a time: numpy over an Arrow batch's bytes, inside Spark's tasks.

The vectors are those of ``model.char_ngram_stages``: an n-gram is the XXH64 chain over its characters' UTF-8 (seed 42,
Spark's ``xxhash64(c1, ..., cn)``), its index the Murmur3 of that long modulo the number of features (``HashingTF``).
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Texts are taken in groups of about so many bytes (a longer text is a group of its own): a group's arrays stay in the cache.
GROUP_BYTES = 1 << 17
SEED = 42
P1, P2, P3, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5


def _step(h, value, prime: int, turn: int, times: int, plus: int = 0):
    """One round of XXH64 over unsigned 64-bit arrays, in ``h`` itself."""
    import numpy as np
    h ^= value * np.uint64(prime)
    high = h >> np.uint64(64 - turn)
    h <<= np.uint64(turn)
    h |= high
    h *= np.uint64(times)
    if plus:
        h += np.uint64(plus)
    return h


def _mixed(h):
    import numpy as np
    h ^= h >> np.uint64(33)
    h *= np.uint64(P2)
    h ^= h >> np.uint64(29)
    h *= np.uint64(P3)
    h ^= h >> np.uint64(32)
    return h


def _chained(seeds, chars, longer, shift: int):
    """The hashes ``seeds`` carried on by the characters from ``shift`` on.

    ``chars`` are the characters' first bytes; ``longer`` has (places, all bytes) of those of 2, 3 and 4 bytes.
    """
    import numpy as np
    n = len(seeds)
    if shift:
        h = _mixed(_step(seeds + np.uint64(P5 + 1), chars[shift:shift + n], P5, 11, P1))
    else:  # all seeds are equal: one hash for each possible byte
        h = _mixed(_step(np.full(256, SEED + P5 + 1, np.uint64), np.arange(256, dtype=np.uint64), P5, 11, P1))[chars[:n]]
    for size, (at, data) in longer.items():
        here = slice(*np.searchsorted(at, (shift, shift + n)))
        if here.start == here.stop:
            continue
        at, data = at[here] - shift, data[:, here]
        g = seeds[at] + np.uint64(P5 + size)
        if size == 4:
            word = data[0] | data[1] << np.uint64(8) | data[2] << np.uint64(16) | data[3] << np.uint64(24)
            g = _step(g, word, P1, 23, P2, P3)
        else:
            for k in range(size):
                g = _step(g, data[k], P5, 11, P1)
        h[at] = _mixed(g)
    return h


def _murmur(longs):
    """Spark's Murmur3 (seed 42) of 64-bit integers, as signed 32-bit integers."""
    import numpy as np
    u = np.uint32
    h = np.full(len(longs), SEED, np.uint32)
    for k in (longs.astype(np.uint32), (longs >> np.uint64(32)).astype(np.uint32)):
        k *= u(0xCC9E2D51)
        k = k << u(15) | k >> u(17)
        k *= u(0x1B873593)
        h ^= k
        h = h << u(13) | h >> u(19)
        h *= u(5)
        h += u(0xE6546B64)
    h ^= u(8)
    h ^= h >> u(16)
    h *= u(0x85EBCA6B)
    h ^= h >> u(13)
    h *= u(0xC2B2AE35)
    h ^= h >> u(16)
    return h.view(np.int32)


def _group(data, ends, n: int, features: int):
    """(texts' places, indices, counts) of the different indices of texts that lie one behind the other in ``data``, ordered."""
    import numpy as np
    first = np.flatnonzero((data & 0xC0) != 0x80)  # lower-cased text is always whole UTF-8
    grams = len(first) - n + 1
    if grams <= 0:
        return (np.zeros(0, np.int64),) * 3
    chars, longer = data[first], {}
    if len(first) < len(data):
        sizes = np.diff(first, append=len(data))
        for size in (2, 3, 4):
            at = np.flatnonzero(sizes == size)
            longer[size] = at, data[first[at] + np.arange(size)[:, None]].astype(np.uint64)
    h = np.full(grams, SEED, np.uint64)
    for k in range(n):
        h = _chained(h, chars, longer, k)
    h = _murmur(h)
    index = h & np.int32(features - 1) if features & (features - 1) == 0 else np.mod(h, np.int32(features))
    kind = np.uint32 if len(ends) * features < 1 << 32 else np.int64  # the short ones are dealt with and sorted faster
    row = np.repeat(np.arange(len(ends), dtype=kind) * kind(features), np.diff(np.searchsorted(first, ends), prepend=0))
    key = row[:grams] + index.astype(kind)
    if len(ends) > 1:
        key = key[row[:grams] == row[n - 1:]]  # an n-gram never spans two texts
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    counts = np.diff(at, append=len(key))
    key = key[at].astype(np.int64)
    row = key // features
    return row, key - row * features, counts


def ngram_counts(texts, n: int, features: int):
    """(ends, indices, counts) of an Arrow array of UTF-8 bytes: text i has the ordered indices ``ends[i - 1]:ends[i]``."""
    import numpy as np
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    number, indices, counts = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + GROUP_BYTES, "right")) - 1)
        row, index, count = _group(data[offsets[lo]:offsets[hi]], offsets[lo + 1:hi + 1] - offsets[lo], n, features)
        number[lo:hi] = np.bincount(row, minlength=hi - lo)
        indices.append(index)
        counts.append(count)
        lo = hi
    return np.cumsum(number), np.concatenate(indices), np.concatenate(counts)


def _vectors_of(n: int, features: int, binary: bool):
    def vectors(texts: pa.Array, again: pa.Array) -> pa.Array:
        import numpy as np
        ends, indices, counts = ngram_counts(texts, n, features)
        at = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        values = np.ones(len(counts)) if binary else counts.astype(np.float64)
        return pa.StructArray.from_arrays([pa.array(np.zeros(len(texts), np.int8)), pa.array(np.full(len(texts), features, np.int32)),
                                           pa.ListArray.from_arrays(at, pa.array(indices.astype(np.int32))),
                                           pa.ListArray.from_arrays(at, pa.array(values))], ["type", "size", "indices", "values"])
    return F.arrow_udf(vectors, VectorUDT())


def add_ngram_vectors(df: DataFrame, text: str, outs: dict[str, tuple[int, int, bool]]) -> DataFrame:
    """``df`` with a sparse vector of each text's hashed n-grams for each name of ``outs``, by (n, features, binary).

    A missing text has no n-grams. All vectors are made in one pass over the texts.
    """
    # The argument is named twice (and sent once), so that Spark keeps it as a column of its own: an argument with a lambda
    # in it, as the normalised text has, would be evaluated in Python but not found there again.
    lowered = df.withColumn("_lower", F.coalesce(F.lower(F.col(f"`{text}`")), F.lit("")).cast("binary"))
    return lowered.withColumns({out: _vectors_of(*kind)("_lower", "_lower") for out, kind in outs.items()}).drop("_lower")
