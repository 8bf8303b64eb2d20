"""Evaluation (A1-A11) as partial/final aggregates.

The only pass over the scored rows is one grouped count (map-side combined);
every metric after it works on a table of at most classes x classes rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reqsight.functions.decide import log_sum_exp, outcome, verdict_status
from reqsight.functions.payload import request_line
from reqsight.functions.rules import label_name
from reqsight.operators.sampling import top_values
from reqsight.session import reliable_checkpoint


def class_distribution(df: DataFrame, col: str = "label_str") -> DataFrame:
    """A1: rows per class, most frequent first."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(col)))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """A3: ``label, pred, n``."""
    return df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """A4: share of rows whose prediction equals the label."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def class_stats(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Per class over labels present in truth or prediction: tp, support, predicted, P, R, F1.

    One pass and one grouped aggregate: every row contributes a truth entry for its
    label and a prediction entry for its prediction (map-side combined, no joins).
    """
    entries = F.array(
        F.struct(F.col(label).alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p"),
                 (F.col(label) == F.col(pred)).cast("int").alias("tp")),
        F.struct(F.col(pred).alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))
    d = (df.select(F.explode(entries).alias("e"))
         .groupBy(F.col("e.cls").alias("cls"))
         .agg(F.sum("e.tp").cast("bigint").alias("tp"), F.sum("e.t").cast("bigint").alias("support"),
              F.sum("e.p").cast("bigint").alias("predicted")))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    d = d.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")), F.lit(0.0))
    return d.withColumn("f1", f1)


def weighted_prf(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """A5: support-weighted precision, recall, F1 (0 on zero division) and accuracy."""
    pc = class_stats(df, label, pred)
    tot = F.sum("support")
    return pc.agg(*[F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), tot), F.lit(0.0)).alias(m)
                    for m in ("precision", "recall", "f1")],
                  F.coalesce(F.try_divide(F.sum("tp").cast("double"), tot), F.lit(0.0)).alias("accuracy"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred",
                          names: bool = True) -> DataFrame:
    """One row per class present in truth or prediction, then accuracy, macro and weighted rows.

    Columns: ``row_order, class, precision, recall, f1, support``. One pass: the per-class rows (one per
    class) are folded into one row, which is exploded into the whole report.
    """
    pc = class_stats(df, label, pred)
    cls = label_name(F.col("cls")) if names else F.col("cls").cast("string")
    none = F.lit(None).cast("double")

    def line(order, name, p, r, f, support):
        return F.struct(order.cast("int").alias("row_order"), name.alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), support.cast("bigint").alias("support"))

    tot = F.sum("support")
    weighted = [F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), tot), F.lit(0.0)) for m in ("precision", "recall", "f1")]
    macro = [F.avg(m) for m in ("precision", "recall", "f1")]
    acc = F.coalesce(F.try_divide(F.sum("tp").cast("double"), tot), F.lit(0.0))
    report = pc.agg(
        F.collect_list(line(F.col("cls"), cls, F.col("precision"), F.col("recall"), F.col("f1"), F.col("support"))).alias("rows"),
        F.array(line(F.lit(100), F.lit("accuracy"), none, none, acc, tot),
                line(F.lit(101), F.lit("macro avg"), *macro, tot),
                line(F.lit(102), F.lit("weighted avg"), *weighted, tot)).alias("sums"))
    return report.select(F.explode(F.concat("rows", "sums")).alias("r")).select("r.*")


def file_rows(scored: DataFrame, file_col: str = "src", text_col: str = "payload",
              type_col: str = "type") -> DataFrame:
    """A7 per row: expected (``normal`` in the lower-cased path, else attack), PASS/FAIL, preview."""
    expected_normal = F.lower(F.col(file_col)).contains("normal")
    pred_attack = F.lower(F.col(type_col)) != F.lit("normal")
    ok = (expected_normal & ~pred_attack) | (~expected_normal & pred_attack)
    return scored.select("*", F.when(expected_normal, F.lit("normal")).otherwise(F.lit("attack")).alias("expected"),
                         F.when(ok, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
                         F.substring(F.col(text_col), 1, 50).alias("preview"))


def file_accuracy(scored: DataFrame, file_col: str = "src", text_col: str = "payload",
                  type_col: str = "type") -> DataFrame:
    """A7 per file: correct, total, percent."""
    r = file_rows(scored, file_col, text_col, type_col)
    return (r.groupBy(file_col)
            .agg(F.sum((F.col("status") == "PASS").cast("bigint")).alias("correct"),
                 F.count(F.lit(1)).alias("total"))
            .withColumn("pct", F.round(F.col("correct") * 100.0 / F.col("total"), 2)))


#: Order-preserving buckets of the distinct values, at least.
VALUE_BUCKETS = 128


def _buckets(s: DataFrame, gcols: list[str], value: str) -> DataFrame:
    """``s`` (one row per distinct value of a group), written once, with ``_b``: the range partition of (group, value).

    Spark samples the bounds from the rows, so buckets are about equal however the values are spread: outliers and skewed
    values only move the bounds, and no result depends on where they lie. NaN is above all numbers.
    """
    n = max(VALUE_BUCKETS, int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return reliable_checkpoint(s.repartitionByRange(n, *gcols, value).withColumn("_b", F.spark_partition_id()))


def _before(s: DataFrame, gcols: list[str], weight: str) -> DataFrame:
    """Per (group, _b): the sum of ``weight`` in all smaller buckets; a group has at most one row per bucket here."""
    prior = Window.partitionBy(*gcols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bt = s.groupBy(*gcols, "_b").agg(F.sum(weight).alias("_w"))
    return bt.withColumn("_off", F.coalesce(F.sum("_w").over(prior), F.lit(0).cast("bigint"))).select(*gcols, "_b", "_off", "_w")


def roc_auc(df: DataFrame, score: str, positive: str, group: str | None = None) -> DataFrame:
    """Exact ROC-AUC with tied scores counted one half (the rank-sum formula).

    Rows are first collapsed to distinct scores (partial aggregation, so a hot score is one row). The
    negatives below each score are a prefix sum inside one of VALUE_BUCKETS order-preserving buckets of the
    score plus the bucket's offset: one method at every size, no single-partition window. Null scores are left out.
    """
    gcols = [group] if group else ["_one"]
    d = df if group else df.withColumn("_one", F.lit(1))
    pos = F.col(positive).cast("boolean")
    s = (d.filter(F.col(score).isNotNull()).groupBy(*gcols, F.col(score).alias("_s"))
         .agg(F.sum(pos.cast("bigint")).alias("_p"), F.sum((~pos).cast("bigint")).alias("_q")))
    s = _buckets(s, gcols, "_s")
    w_in = Window.partitionBy(*gcols, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    s = (s.join(_before(s, gcols, "_q"), [*gcols, "_b"])
         .withColumn("_below", F.col("_off") + F.coalesce(F.sum("_q").over(w_in), F.lit(0))))
    agg = s.groupBy(*gcols).agg(
        F.sum(F.col("_p") * (F.col("_below") + F.col("_q") * 0.5)).alias("_num"),
        F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"))
    auc = F.try_divide(F.col("_num"), F.col("n_pos").cast("double") * F.col("n_neg"))
    return agg.select(*([group] if group else []), auc.alias("auc"), "n_pos", "n_neg")


def latency_summary(df: DataFrame, col: str, group: str | None = None) -> DataFrame:
    """Count, mean and exact p50/p95/p99 (the smallest value that covers the share), one method at every size.

    Values are collapsed to counts (partial aggregation); the bucket that holds a percentile's rank is found from
    bucket totals, and only these buckets' distinct values are ranked.
    """
    gcols = [group] if group else ["_one"]
    d = df if group else df.withColumn("_one", F.lit(1))
    base = d.groupBy(*gcols).agg(F.count(col).alias("n"), F.avg(col).alias("mean"))
    v = d.filter(F.col(col).isNotNull()).groupBy(*gcols, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    v = _buckets(v, gcols, "_v")
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    want = F.array(*[F.struct(F.lit(p).alias("name"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(q))).alias("rank")) for p, q in shares.items()])
    ranks = base.select(*gcols, F.explode(want).alias("r")).select(*gcols, "r.*")
    holds = _before(v, gcols, "_k").join(ranks, gcols).filter((F.col("_off") < F.col("rank")) & (F.col("rank") <= F.col("_off") + F.col("_w")))
    run = F.sum("_k").over(Window.partitionBy(*gcols, "name", "_b").orderBy("_v"))
    hit = (v.join(holds.select(*gcols, "_b", "_off", "name", "rank"), [*gcols, "_b"])
           .withColumn("_run", F.col("_off") + run).filter(F.col("_run") >= F.col("rank")))
    got = hit.groupBy(*gcols).agg(*[F.min(F.when(F.col("name") == p, F.col("_v"))).alias(p) for p in shares])
    return base.join(got, gcols, "left").select(*([group] if group else []), "n", "mean", *shares)


def cross_entropy(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """A10: mean of -log softmax(logits)[label]."""
    nll = log_sum_exp(logits) - F.element_at(F.col(logits), F.col(label) + 1)
    return df.agg(F.avg(nll).alias("cross_entropy"), F.count(F.lit(1)).alias("n"))


def suite_report(cases: DataFrame, type_col: str = "type", payload: str = "payload") -> DataFrame:
    """Per suite case: payload, BLOCKED/ALLOWED, class upper-cased, requests, pass against expectation."""
    st = verdict_status(F.col(type_col), F.col(payload))
    d = cases.select("name", payload, "expected_class", outcome(st).alias("outcome"),
                     F.upper(F.col(type_col)).alias("detected"),
                     (F.col(type_col) == F.col("expected_class")).alias("_ok"))
    return (d.groupBy("name", payload, "expected_class", "outcome", "detected")
            .agg(F.count(F.lit(1)).alias("requests"), F.bool_and("_ok").alias("passed")))


def suite_pass_rate(report: DataFrame) -> DataFrame:
    """Share of cases (by name) of which every request passed."""
    cases = report.groupBy("name").agg(F.bool_and("passed").alias("passed"), F.sum("requests").alias("requests"))
    return cases.agg(F.avg(F.col("passed").cast("double")).alias("pass_rate"),
                     F.count(F.lit(1)).alias("cases"), F.sum("requests").alias("requests"))


def profile_log(log: DataFrame, key: str, k: int = 10, head: int = 5) -> DataFrame:
    """A2: total rows, the first ``head`` rows' request lines (by ``key``) and the top-``k`` rules.

    One long table: ``section, rank, value, n``.
    """
    total = log.agg(F.lit("total").alias("section"), F.lit(0).cast("bigint").alias("rank"),
                    F.lit(None).cast("string").alias("value"), F.count(F.lit(1)).alias("n"))
    line = request_line("http_method", "http_path", "http_query")
    sample = (log.select(F.col(key), line.alias("value")).orderBy(key).limit(head)
              .withColumn("rank", F.row_number().over(Window.orderBy(key)).cast("bigint"))
              .select(F.lit("sample").alias("section"), "rank", "value",
                      F.lit(None).cast("bigint").alias("n")))
    top = top_values(log, "rule_names", k)
    top = (top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("n"), F.asc_nulls_last("rule_names"))).cast("bigint"))
        .select(F.lit("top_rule").alias("section"), "rank", F.col("rule_names").alias("value"), "n"))
    return total.unionByName(sample).unionByName(top)

