"""Chat formatting: typed content parts flattened by a visitor into one marked-up text per conversation.

A message's content is an array of typed parts ``struct<kind, text, ref, units>``. The visitor turns a
text part into its escaped text, and an image, audio or document part into its placeholder, repeated as
often as the part expands to tokens; it records the attachment references in order. Each message becomes
``<|im_start|>role\\ntext<|im_end|>\\n``; the text of the trained roles lies under the loss mask, given as
(start, length) spans in code points.

Escaping: in texts and roles, ``<``, any number of backslashes, ``|`` gets one more backslash, so
``<|`` never comes from a text; roles also write backslashes and line ends as ``\\b`` and ``\\n``. ``unescape`` takes exactly
that back. Messages are formatted before the shuffle. The output has one row for each
(conversation, segment) of ``turns_per_segment`` turn numbers. A segment of more messages than that (null or
equal turns) or of more than ``SEGMENT_CHARS`` characters is cut again, in the order of its messages, into rows
of growing ``part``; other segments are part 0. So a conversation of any length is split over rows of at most
``turns_per_segment`` messages and, unless one message is longer, ``SEGMENT_CHARS`` characters; its formatted
text is that of its rows by (segment, part), one after the other. ``whole`` marks a conversation of one row.

Defined results: null text, content or role: empty; a null turn comes first; equal turns are ordered by
role, then text; a null conv_id is a conversation of its own; repeated rows are repeated messages; an
empty table gives no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reqsight.llm.common import attach, by_value, checkpoint, pick

by_value(__name__)

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Units that make up one placeholder token: image patches, audio frames, document pages.
UNITS_PER_TOKEN = {"image": 4, "audio": 8, "document": 1}
TRAINED_ROLES = ("assistant",)
TURNS_PER_SEGMENT = 1024
SEGMENT_CHARS = 1 << 22
#: First characters of a message that deal an over-long segment out by range; Spark samples them to the driver.
RANGE_CHARS = 256
PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def escape_role(c: Column) -> Column:
    """Backslash and line end as backslash-b and backslash-n, then as any text."""
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def text_parts(c: Column) -> Column:
    """A plain text as content: one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), c.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("bigint").alias("units")))


def n_tokens(part: Column) -> Column:
    """Placeholder tokens that an attachment expands to: at least one."""
    case = F.lit(0).cast("bigint")
    for kind, per in UNITS_PER_TOKEN.items():
        case = F.when(part["kind"] == kind, F.greatest(F.lit(1), F.ceil(F.coalesce(part["units"], F.lit(1)) / per))).otherwise(case)
    return case


def visit(parts: Column) -> Column:
    """The parts as formatted text; neighbouring text parts are escaped as one text, so no mark arises where they meet."""
    def step(a, p):
        mark = F.lit("")
        for kind, m in PLACEHOLDER.items():
            mark = F.when(p["kind"] == kind, F.repeat(F.lit(m), n_tokens(p).cast("int"))).otherwise(mark)
        return F.when(p["kind"].isin(*PLACEHOLDER), F.struct(
            F.concat(a["done"], escape(a["text"]), mark).alias("done"), F.lit("").alias("text"))).otherwise(F.struct(
                a["done"].alias("done"), F.concat(a["text"], F.coalesce(p["text"], F.lit(""))).alias("text")))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("text"))
    return F.aggregate(parts, start, step, lambda a: F.concat(a["done"], escape(a["text"])))


def messages(rows: DataFrame, content: Column, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
             turns_per_segment: int = TURNS_PER_SEGMENT, columns: dict[str, str] | None = None) -> DataFrame:
    """One row per message: conv_id, segment, turn, role, head, body, refs."""
    m = pick(rows, conv_id=conv_id, turn=turn, role=role, **(columns or {}))
    m = m.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                 F.coalesce(content.cast(PARTS), F.array().cast(PARTS)).alias("parts"))
    segment = F.coalesce(F.floor(F.col("turn") / turns_per_segment), F.lit(-(1 << 62))).cast("bigint")
    return m.select(
        "conv_id", segment.alias("segment"), "turn", "role",
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        visit(F.col("parts")).alias("body"),
        F.transform(F.filter("parts", lambda p: p["kind"].isin(*PLACEHOLDER)), lambda p: F.struct(
            p["kind"].alias("kind"), p["ref"].alias("ref"), n_tokens(p).alias("tokens"))).alias("refs"))


def _sizes(m: DataFrame, turns_per_segment: int) -> DataFrame:
    """Each segment's messages, longest message, and whether it is too long for one row."""
    size = F.length("head") + F.length("body") + (len(END) + 1)
    return m.groupBy("conv_id", "segment").agg(
        F.count("*").alias("n"), F.max(size).alias("longest"), F.sum(size).alias("chars")).withColumn(
        "over", (F.col("n") > turns_per_segment) | (F.col("chars") > SEGMENT_CHARS))


def long_conversations(m: DataFrame, turns_per_segment: int = TURNS_PER_SEGMENT) -> DataFrame | None:
    """(conv, n): the conversations of more than one row and their messages; None if there are none."""
    found = _sizes(m, turns_per_segment).groupBy("conv_id").agg(
        F.sum("n").alias("n"), F.count("*").alias("segments"), F.max("over").alias("over")).filter("segments > 1 OR over")
    found = checkpoint(found.select(F.struct("conv_id").alias("conv"), "n"))  # a struct: null ids match, too
    return None if found.isEmpty() else found


def _cut(m: DataFrame, turns_per_segment: int) -> DataFrame:
    """``m`` of long conversations with ``part``: over-long segments are sorted by range over all tasks and cut by row numbers."""
    over = checkpoint(_sizes(m, turns_per_segment).filter("over").select(
        F.struct("conv_id", "segment").alias("seg"), "n",
        F.greatest(F.lit(1), F.least(F.lit(turns_per_segment), F.lit(SEGMENT_CHARS) / F.col("longest"))).cast("bigint").alias("step")))
    if over.isEmpty():
        return m.withColumn("part", F.lit(0).cast("bigint"))
    m = m.withColumns({"seg": F.struct("conv_id", "segment"), "spread": F.xxhash64("turn", "role", "body")})
    m = attach(m, over.withColumnRenamed("n", "seg_n"), "seg", "seg_n", "spread")
    fits = m.filter("step IS NULL").withColumn("part", F.lit(0).cast("bigint"))
    order = ["conv_id", "segment", "turn", "role"]
    dealt = m.filter("step IS NOT NULL").withColumn("start", F.substring("body", 1, RANGE_CHARS))
    dealt = dealt.repartitionByRange(*order, "start").sortWithinPartitions(*order, "body", "refs")
    # the id is (task << 33) + row, so (task << 33) + row div step grows with the order and never spans tasks
    dealt = dealt.withColumn("at", F.monotonically_increasing_id()).withColumn(
        "part", F.col("at").bitwiseAND(F.lit(-(1 << 33))) + F.expr(f"(at & {(1 << 33) - 1}L) div step"))
    return fits.unionByName(dealt.select(*fits.columns)).drop("seg", "spread", "seg_n", "step")


def segments(m: DataFrame, long: DataFrame | None, trained_roles: tuple[str, ...] = TRAINED_ROLES,
             turns_per_segment: int = TURNS_PER_SEGMENT) -> DataFrame:
    """The rows of ``format_conversations`` from ``messages`` and their ``long_conversations``."""
    if long is None:
        m = m.withColumns({"part": F.lit(0).cast("bigint"), "whole": F.lit(True)})
    else:
        m = m.withColumns({"conv": F.struct("conv_id"), "spread": F.xxhash64("turn", "role", "body")})
        m = attach(m, long, "conv", "n", "spread").drop("conv", "spread")
        short = m.filter("n IS NULL").drop("n").withColumns({"part": F.lit(0).cast("bigint"), "whole": F.lit(True)})
        m = short.unionByName(_cut(m.filter("n IS NOT NULL").drop("n"), turns_per_segment).withColumn("whole", F.lit(False)))
    message = F.struct(
        "turn", "role", "body", "refs", F.concat("head", "body", F.lit(END + "\n")).alias("full"),
        F.length("head").cast("bigint").alias("head_len"), F.length("body").cast("bigint").alias("body_len"),
        F.col("role").isin(*trained_roles).alias("trained"))
    seg = m.groupBy("conv_id", "segment", "part", "whole").agg(F.array_sort(F.collect_list(message)).alias("m"))
    state = F.struct(F.lit(0).cast("bigint").alias("at"),
                     F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    tail = len(END) + 1
    spans = F.aggregate("m", state, lambda a, x: F.struct(
        (a["at"] + x["head_len"] + x["body_len"] + tail).alias("at"),
        F.when(x["trained"], F.concat(a["spans"], F.array(F.struct(
            (a["at"] + x["head_len"]).alias("start"), x["body_len"].alias("length"))))).otherwise(a["spans"]).alias("spans")))
    attachments = F.flatten(F.transform("m", lambda x: x["refs"]))
    out = seg.select("conv_id", "segment", "part", "whole", F.size("m").cast("bigint").alias("n_turns"),
                     F.array_join(F.transform("m", lambda x: x["full"]), "").alias("formatted"),
                     spans["spans"].alias("loss"), attachments.alias("attachments"))
    return out.withColumn("n_placeholder_tokens", F.aggregate(
        "attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]))


def format_conversations(rows: DataFrame, content: Column, conv_id: str = "conv_id", turn: str = "turn",
                         role: str = "role", trained_roles: tuple[str, ...] = TRAINED_ROLES,
                         turns_per_segment: int = TURNS_PER_SEGMENT, columns: dict[str, str] | None = None) -> DataFrame:
    """One row per (conv_id, segment, part): whole, n_turns, formatted, loss (array of start, length), attachments, n_placeholder_tokens.

    ``content`` is a column of parts over the renamed inputs ``conv_id, turn, role`` and those of ``columns``
    (new name -> old name), for instance ``text_parts(F.col("text"))`` with ``{"text": "text"}``.
    """
    m = messages(rows, content, conv_id, turn, role, turns_per_segment, columns)
    return segments(m, long_conversations(m, turns_per_segment), trained_roles, turns_per_segment)


def read_back(formatted: Column) -> Column:
    """The messages of a formatted text: array of struct(role, text), unescaped."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    pieces = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def message(p):
        at = F.locate("\n", p) if isinstance(p, str) else F.instr(p, "\n")
        return F.struct(unescape_role(F.substr(p, F.lit(1), at - 1)).alias("role"),
                        unescape(F.substr(p, at + 1, F.length(p) - at - (len(END) + 1))).alias("text"))

    return F.transform(pieces, message)


def under_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def _digest_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, then place: a SHA-256 state for the turns and one for the loss, fed row by row."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, sums, hashes = None, None, None

    def done(kind: pa.DataType) -> pa.RecordBatch:
        row = [now[0], sums[0], hashes[0].hexdigest(), sums[1], hashes[1].hexdigest(), sums[2]]
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

    for batch in batches:
        kind = batch.column("conv_id").type
        for i in range(batch.num_rows):
            conv, n, loss_chars, chars, turns, loss = (
                batch.column(c)[i].as_py() for c in ("conv_id", "n", "loss_chars", "chars", "turns", "loss_text"))
            if now != (conv,):
                if now is not None:
                    yield done(kind)
                now, sums, hashes = (conv,), [0, 0, 0], (hashlib.sha256(), hashlib.sha256())
            sums = [sums[0] + n, sums[1] + loss_chars, sums[2] + chars]
            hashes[0].update(turns.encode())
            hashes[1].update(loss.encode())
    if now is not None:
        yield done(kind)


def conversation_digests(seg: DataFrame, any_long: bool) -> DataFrame:
    """One row per conversation, read back from ``segments``: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation of one row is digested where it is, by DataFrame functions. The rows of a longer one are sorted
    in one task and fed to SHA-256 one after the other (Arrow), so no row, string or task memory grows with its length.
    """
    back = seg.select("conv_id", "segment", "part", "whole", F.length("formatted").cast("bigint").alias("chars"),
                      read_back(F.col("formatted")).alias("m"),
                      F.array_join(under_loss(F.col("formatted"), F.col("loss")), "").alias("loss_text"))
    back = back.select("conv_id", "segment", "part", "whole", "chars", "loss_text", F.length("loss_text").cast("bigint").alias("loss_chars"),
                       F.size("m").cast("bigint").alias("n"), F.array_join(
                           F.transform("m", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("turns"))
    short = back.filter("whole").select(
        "conv_id", F.col("n").alias("n_turns"), F.sha2("turns", 256).alias("turns_sha256"), "loss_chars",
        F.sha2("loss_text", 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"))
    if not any_long:
        return short
    rows = back.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "segment", "part")
    kind = back.schema["conv_id"].dataType.simpleString()
    return short.unionByName(rows.select("conv_id", "n", "loss_chars", "chars", "turns", "loss_text").mapInArrow(
        _digest_sorted, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"))
