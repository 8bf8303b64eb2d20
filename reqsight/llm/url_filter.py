"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes.

Every URL is expanded into expressions ``host-suffix + path-prefix``; both the expressions and the
rules carry a SHA-256 digest, whose first ``PREFIX_HEX`` hex digits are the join key. A prefix match is
confirmed by the full digest, and of the confirmed rules the one with the longest host, then the
longest path, decides. An expansion only has the (host labels, path length) shapes that some rule has,
which loses nothing and keeps a URL with many labels and slashes from growing into a product of both.

Work is done once for each distinct (host, path); verdicts go back to the pages by a join that is safe
against hot hosts. Defined results: a null URL or one without ``://`` has empty host and path and fits
no rule; a rule given twice with both verdicts blocks; without a fitting rule the verdict is
``default``; repeated pages are judged row by row; no rule at all gives every page the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reqsight.llm.common import ascii_lower, attach_counted, checkpoint, pick

PREFIX_HEX = 8  # 32 bits


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with expression, digest, key, labels and path length; one row per expression."""
    r = pick(rules, host="host", path="path", verdict="verdict").fillna("", ["host", "path"])
    r = r.withColumns({"host": ascii_lower(F.col("host")), "rule": F.concat(ascii_lower(F.col("host")), F.col("path"))})
    r = r.groupBy("host", "path", "rule").agg(F.max("verdict").alias("verdict"))  # 'block' > 'allow'
    digest = F.sha2(F.concat_ws("\u0001", "host", "path"), 256)
    return r.select("rule", "verdict", digest.alias("digest"), F.substring(digest, 1, PREFIX_HEX).alias("key"),
                    F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_len"),
                    F.length("host").alias("host_len"))


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The URL's expressions of the given (labels, path length) shapes: array of struct(host, path)."""
    labels = F.size(F.split(host, r"\."))
    made = [F.when((host != "") & (labels >= n) & (F.length(path) >= m),
                   F.struct(F.substring_index(host, ".", -n).alias("host"), F.substring(path, 1, m).alias("path")))
            for n, m in shapes]
    return F.array_compact(F.array(*made)) if made else F.array().cast("array<struct<host:string,path:string>>")


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule (null without one), verdict."""
    table = rules_table(rules)
    # distinct shapes of the rules: at most (labels of a host name) x (length of a path), not the rules
    shapes = [(r["labels"], r["path_len"]) for r in table.select("labels", "path_len").distinct().collect()]
    rows = pick(pages, page_id=page_id, url=url).select(
        "page_id", F.struct(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).alias("hp"))
    keys = rows.select("hp").distinct()
    found = keys.select("hp", F.explode(expressions(F.col("hp.host"), F.col("hp.path"), sorted(shapes))).alias("e"))
    digest = F.sha2(F.concat_ws("\u0001", "e.host", "e.path"), 256)
    found = found.withColumn("e_digest", digest).withColumn("e_key", F.substring("e_digest", 1, PREFIX_HEX))
    hits = (found.join(table, F.col("e_key") == F.col("key"))          # short prefix: the equi-join
            .filter(F.col("e_digest") == F.col("digest")))             # full digest: the proof
    best = hits.groupBy("hp").agg(
        F.max_by(F.struct("rule", "verdict"), F.struct("host_len", "path_len", "rule")).alias("best"))
    out = attach_counted(rows, checkpoint(best), "hp", "page_id")
    return out.select("page_id", "hp.host", "hp.path", F.col("best.rule").alias("rule"),
                      F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
