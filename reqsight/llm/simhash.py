"""SimHash near-dedup with covering locality-sensitive hashing.

A text's fingerprint sums the bits of XXH64 (seed 42) over its word shingles. Fingerprints within
``RADIUS`` bits are linked. The covering family has ``2^(radius+1) - 1`` tables: bit i gets the non-zero
vector ``m(i) = i mod (2^(radius+1) - 1) + 1`` of radius + 1 bits, and table v keeps the bits with
``<m(i), v> = 1``. The vectors of at most ``radius`` differing bits span too little to rule out every v,
so every pair within the radius agrees on all kept bits of some table: no pair is missed.

Only distinct fingerprints enter the tables, so copies cost nothing. In buckets of two or more fingerprints
pairs are not compared: each member is expanded into its variants of at most radius/2 flipped bits among
those its table leaves out, and two fingerprints within the radius share a variant, while all that share
one are within the radius of each other. A variant has at most 65 distinct neighbours at radius 2, so
these groups are small by geometry, whatever the size of a bucket. Linking each group to its smallest member
keeps the links linear. Components come from alternating large-star and small-star steps, checkpointed in
the shared folder; hubs are resolved by ``attach``. Nothing is collected to the driver.

Defined results: null counts as empty; a text without words has fingerprint zero and is linked like any
other; fewer words than a shingle: the whole sequence is the one shingle; repeated rows are members like
others; null ids count only when nothing else is there (component_id null); ``drop_near_duplicates`` leaves
the row of the smallest id of each component, and of several such rows the one with the smallest columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from reqsight.llm.common import attach, by_value, checkpoint, pick, restore, with_columns

by_value(__name__)

SHINGLE = 3
RADIUS = 2
SEED = 42
BITS = 64
MAX_ROUNDS = 100


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a whole text."""
    words = (text or "").encode().lower().split()  # on bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, 1 << 16):
        part = words[start:min(n, start + (1 << 16)) + shingle - 1]
        grams = zip(*[part[k:] for k in range(shingle)]) if len(words) >= shingle else [words]
        h = np.fromiter((digest(b" ".join(g), SEED) for g in grams), np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def _mapper(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t")
            fp = pa.array((fingerprint(texts[i].as_py(), shingle) for i in range(batch.num_rows)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], names=["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row."""
    rows = pick(docs, doc_id=doc_id, t=text)
    return rows.mapInArrow(_mapper(shingle), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int) -> list[int]:
    """The kept bits of each table (unsigned)."""
    size = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if (i % size + 1 & v).bit_count() % 2) for v in range(1, size + 1)]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: links that connect all distinct fingerprints (column fp) within the radius."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even")
    masks = covering_masks(radius)
    cells = nodes.select("fp", F.explode(F.array(*[F.struct(
        F.lit(i).alias("cover"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("kept")) for i, m in enumerate(masks)])).alias("c"))
    cells = cells.select("fp", "c.*")
    full = cells.groupBy("cover", "kept").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    near = cells.join(full, ["cover", "kept"], "left_semi")
    # a table's left-out bits, any of which a near fingerprint may flip
    flips = F.array(*[F.array(*[F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks])
    grown = near.select("fp", "cover", F.col("fp").alias("variant"))
    for _ in range(radius // 2):
        grown = grown.select("fp", "cover", F.explode(F.concat(F.array("variant"), F.transform(
            F.get(flips, F.col("cover")), lambda b: F.col("variant").bitwiseXOR(b)))).alias("variant"))
    met = grown.groupBy("variant").agg(F.array_sort(F.collect_set("fp")).alias("s")).filter(F.size("s") > 1)
    pairs = met.select(F.get("s", F.lit(0)).alias("a"), F.explode(F.slice("s", 2, F.size("s"))).alias("b"))
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the smallest connected node of every node that has a link."""
    def nearest(pairs: DataFrame) -> DataFrame:  # (u, v) with m, the smallest v of u
        table = checkpoint(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        return attach(pairs, table, "u", "n", "v")

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = checkpoint(edges.select("a", "b"))
    before = state(e)
    for _ in range(MAX_ROUNDS):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        large = nearest(both).select(F.least("u", "m").alias("a"), F.col("v").alias("b"), "u").filter("b > u AND a < b").select("a", "b")
        e = checkpoint(large.distinct())
        down = nearest(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        small = down.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).filter("a < b")
        e = checkpoint(small.distinct())
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("b").alias("fp"), F.col("a").alias("root")).union(
        e.select(F.col("a").alias("fp"), F.col("a").alias("root")).distinct())


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fp, root (smallest fingerprint of the component), component_id, members."""
    rows = checkpoint(fingerprints(docs, doc_id, text, shingle))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("d"), F.count("*").alias("n")))
    roots = checkpoint(components(links(nodes, radius)))
    known = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = checkpoint(known.filter(F.col("n") > 1).unionByName(known.filter("n = 1").join(roots.select("fp"), "fp", "left_semi")))
    whole = known.groupBy("root").agg(F.min("d").alias("component_id"), F.sum("n").alias("members"))
    table = checkpoint(known.select("fp", "root", "n").join(whole, "root"))
    out = attach(rows, table, "fp", "n", "doc_id")
    alone = F.col("root").isNull()
    return out.select("doc_id", "fp", F.coalesce("root", "fp").alias("root"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                      F.coalesce("members", F.lit(1)).cast("bigint").alias("members"))


def hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                         radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, one for each component, with all their columns."""
    groups = near_groups(docs, doc_id, text, shingle, radius).filter("members > 1")
    # a row is named by its id and fingerprint; a component's staying rows all carry its component_id
    table = groups.groupBy(F.struct("doc_id", "fp").alias("k")).agg(
        F.first("root").alias("root"), F.count("*").alias("copies"),
        F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stay"))
    ties = table.filter("stay").groupBy("root").agg(F.sum("copies").alias("same"))
    table = checkpoint(table.join(ties, "root", "left").select("k", "root", "copies", "stay", "same"))
    flat, names = with_columns(docs, k_id=doc_id, k_text=text)
    data = [f"in_{i}" for i in range(len(names))]
    ids = flat.schema["k_id"].dataType.simpleString()
    kinds = ", ".join(f"{c} {flat.schema[c].dataType.simpleString()}" for c in data)

    def run(batches, one=_mapper(shingle)):
        for batch in batches:
            named = pa.RecordBatch.from_arrays([batch.column("k_id"), batch.column("k_text")], names=["doc_id", "t"])
            fp = next(one(iter([named]))).column("fp")
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in data], batch.column("k_id"), fp], names=[*data, "k_id", "fp"])

    marked = flat.mapInArrow(run, f"{kinds}, k_id {ids}, fp bigint").withColumn("k", F.struct(F.col("k_id").alias("doc_id"), F.col("fp")))
    marked = attach(marked, table, "k", "copies", "k_id")
    single = marked.filter("stay IS NULL OR (stay AND same = 1)")
    tied = marked.filter("stay AND same > 1").groupBy("root").agg(F.min(F.struct(*data)).alias("row")).select("row.*")
    return restore(single.select(*data).unionByName(tied), names)
