"""Structured Streaming jobs.

W1 is stateless (each micro-batch is the batch scoring path: P1 where the source is built, P2, scorer, D5). W2 keeps one
state row per open (window, type) and drops rows later than the watermark.
W3 writes each micro-batch to a folder named by its batch id, overwriting on
a replay, so a restarted query after an executor or driver loss is idempotent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reqsight.functions.decide import verdict
from reqsight.functions.payload import bound, is_empty_payload, joined_views
from reqsight.functions.rules import rule_scorer


def rule_score(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Scorer used where no trained model is given: payload rules over the decoded views."""
    # bound, as Spark computes an expression that stands under ``when`` anew for each of its uses (a use for each keyword)
    scored = bound(joined_views(F.col(payload)), rule_scorer)
    return df.withColumn("type", F.when(~is_empty_payload(payload), scored))


def score_requests(df: DataFrame, scorer=None, payload: str = "payload",
                   on_error: str = "ATTACK") -> DataFrame:
    """W1 body, also usable on a batch DataFrame: score -> verdict columns."""
    scored = scorer(df) if scorer is not None else rule_score(df, payload)
    v = verdict(F.col("type"), F.col(payload), on_error)
    return scored.withColumn("_v", v).select(
        *[c for c in scored.columns if c != "type"], F.col("_v.status").alias("status"),
        F.col("_v.type").alias("type"))


def score_stream(stream: DataFrame, sink_path: str, checkpoint: str, scorer=None,
                 payload: str = "payload", trigger: dict | None = None, fmt: str = "parquet"):
    """Append-only scoring stream to a file sink with a checkpoint."""
    out = score_requests(stream, scorer, payload)
    w = (out.writeStream.format(fmt).outputMode("append").option("path", sink_path)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def attack_rate(df: DataFrame, window: str = "1 day", slide: str | None = None,
                delay: str | None = "1 day", ts: str = "ts", type_col: str = "type",
                status: str = "status") -> DataFrame:
    """Rows and attacks per event-time window and class (tumbling or sliding).

    With ``delay`` set, rows older than the watermark are dropped and the
    state of closed windows is released.
    """
    d = df.withWatermark(ts, delay) if delay else df
    win = F.window(F.col(ts), window, slide) if slide else F.window(F.col(ts), window)
    return (d.groupBy(win.alias("window"), F.col(type_col))
            .agg(F.count(F.lit(1)).alias("requests"),
                 F.sum((F.col(status) == F.lit("ATTACK")).cast("bigint")).alias("attacks")))


def attack_rate_table(rates: DataFrame, table_path: str, checkpoint: str, trigger: dict | None = None):
    """W2 to a table: every micro-batch writes the windows it changed (update mode), under its batch id.

    ``latest_windows`` reads the last state of each window, open ones included; a replayed batch overwrites itself.
    """
    def write_batch(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{table_path.rstrip('/')}/batch_id={batch_id}")

    w = rates.writeStream.outputMode("update").foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def closed_windows(rates: DataFrame, table_path: str, checkpoint: str, trigger: dict | None = None, fmt: str = "parquet"):
    """W2 to an append-only table: each window once, when the watermark passes its end and its state is released.

    Needs a watermark (``delay`` of ``attack_rate``); rows of closed windows that come later are dropped and counted in
    the query's progress (``numRowsDroppedByWatermark``).
    """
    w = rates.writeStream.format(fmt).outputMode("append").option("path", table_path).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def latest_windows(table: DataFrame, type_col: str = "type") -> DataFrame:
    """The newest row of each (window, type) of a table written by ``attack_rate_table``."""
    newest = F.max_by(F.struct("requests", "attacks"), "batch_id").alias("r")
    return table.groupBy("window", type_col).agg(newest).select("window", type_col, "r.requests", "r.attacks")


def window_start_text(c: Column | str = "window") -> Column:
    """Window start as UTC wall-clock text, independent of the session time zone."""
    c = F.col(c) if isinstance(c, str) else c
    utc = F.convert_timezone(None, F.lit("UTC"), c["start"].cast("timestamp_ntz"))
    return F.date_format(utc, "yyyy-MM-dd HH:mm:ss")


def collect_training_rows(stream: DataFrame, table_path: str, checkpoint: str,
                          trigger: dict | None = None, payload: str = "payload"):
    """Append labelled request rows per micro-batch, idempotent by batch id."""
    def write_batch(batch: DataFrame, batch_id: int):
        rows = batch.select(F.col(payload).alias("text"), F.col("type").alias("label_str"))  # an empty payload has no label
        rows.write.mode("overwrite").parquet(f"{table_path.rstrip('/')}/batch_id={batch_id}")

    labelled = rule_score(stream, payload)
    w = labelled.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()
