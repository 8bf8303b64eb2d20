"""Secret scans with a trigram inverted index.

Every rule is a regex; its Boolean trigram query, an OR of ANDs that holds for every text with a match,
is derived from the regex by ``reqsight.llm.trigrams``. The index holds postings (trigram, text key) for the trigrams that the rules' queries name, taken from
the lower-cased text. Postings are joined to the queries' clauses and intersected (a clause holds for a
text if all of its trigrams do); only the candidate texts of a rule are verified by its regex. Rules
without mandatory trigrams scan every text. Texts are named by their SHA-256, so copies share their
postings and their verification, and hot groups of copies are resolved by ``attach``.

Positions come from built-in functions only: ``regexp_extract_all`` gives a rule's matches and ``split``
the text between them, so a span's start is the summed length of what stands before it. The sums are
running ones over all pieces of a text, doubled in reach with each pass: n findings cost n log n.

Besides the base kinds assign, access and hex the library's rules find private key headers (pem) and
three-part signed web tokens (jwt). Defined results: null or empty text has no spans; repeated rows are
reported row by row; overlapping spans of different kinds are all reported; equal starts are ordered as
the rules are listed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from reqsight.functions.payload import bound
from reqsight.llm import trigrams
from reqsight.llm.common import ascii_lower, attach_counted, checkpoint, pick, text_key


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: group whose length counts, and the shortest length that is a finding
    group: int = 0
    least: int = 1


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # runs under 16 characters are no findings, so only longer ones are matched: the same runs
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)


def trigram_query(rule: Rule) -> list[set[str]]:
    """OR of ANDs over lower-case trigrams; empty if the rule's matches need none, so that it scans every text."""
    clauses = [set(c) for c in trigrams.query(rule.regex)]
    return clauses if all(clauses) else []


def running_sums(values: Column) -> Column:
    """Inclusive prefix sums of an array: pass k adds to each value the one 2^k places before it."""
    reach = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    return F.aggregate(reach, values, lambda a, k: F.transform(
        a, lambda x, i: x + F.coalesce(F.get(a, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """All findings of a rule: array of struct(start, ord, end, kind), code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    sizes = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.regex, -1)
    pieces = F.zip_with(F.arrays_zip(found.alias("hit"), sizes.alias("size")), gaps, lambda x, gap: F.struct(
        F.length(gap).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["size"]).alias("size")))
    # one piece more than findings: the text behind the last one

    def placed(v):
        ends = F.transform(v, lambda x: x["gap"] + F.coalesce(x["hit"], F.lit(0)))
        spans = bound(running_sums(ends), lambda e: F.zip_with(v, e, lambda x, end: F.struct(
            (end - x["hit"]).alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"),
            x["size"].alias("size"))))
        return F.transform(F.filter(spans, lambda s: s["size"] >= rule.least),
                           lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind")))

    return bound(pieces, placed)


def postings(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(trigram, key): which of the queries' trigrams each text (columns key, t) holds; each pair once."""
    low = rows.select("key", ascii_lower(F.col("t")).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in vocabulary]))
    return low.select("key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): the rules whose trigram query holds for a text, by intersecting postings."""
    spark = index.sparkSession
    clauses = [(r.kind, f"{r.kind}/{i}", g, len(c)) for r in rules for i, c in enumerate(trigram_query(r)) for g in sorted(c)]
    table = spark.createDataFrame(clauses, "kind string, clause string, trigram string, need int")  # as long as the rules
    # a text is in every posting list of a clause: one row per (key, clause) with all trigrams of the clause
    met = (index.join(F.broadcast(table), "trigram").groupBy("key", "kind", "clause", "need")
           .agg(F.count_distinct("trigram").alias("n")).filter("n = need"))
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (array of struct(start, ord, end, kind) by start, then rule order)."""
    rows = pick(docs, doc_id=doc_id, t=text).withColumn("t", F.coalesce("t", F.lit("")))
    rows = rows.withColumn("key", text_key(F.col("t")))
    indexed = [(i, r) for i, r in enumerate(rules) if trigram_query(r)]
    full = [(i, r) for i, r in enumerate(rules) if not trigram_query(r)]
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    always = F.flatten(F.array(*[spans_of(F.col("t"), r, i) for i, r in full])) if full else none
    if not indexed:
        return rows.select("doc_id", F.array_sort(always).alias("spans"))
    vocabulary = sorted(set().union(*(c for _, r in indexed for c in trigram_query(r))))
    cand = candidates(postings(rows, vocabulary), tuple(r for _, r in indexed))
    marked = attach_counted(rows, checkpoint(cand), "key", "doc_id")
    checked = F.flatten(F.array(*[
        F.when(F.array_contains(F.col("kinds"), r.kind), spans_of(F.col("t"), r, i)).otherwise(none) for i, r in indexed]))
    return marked.select("doc_id", F.array_sort(F.concat(
        always, F.when(F.col("kinds").isNull(), none).otherwise(checked))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
