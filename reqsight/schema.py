"""Explicit schemas of the data model (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

SAMPLES = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("label_str", T.StringType()),
    T.StructField("label", T.IntegerType()),
])

REQUEST_LOG_COLUMNS = ("http_method", "http_path", "http_query", "rule_names")

REQUEST_EVENT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("args", T.MapType(T.StringType(), T.StringType())),
    T.StructField("payload", T.StringType()),
])

ENCODED = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("mask", T.ArrayType(T.IntegerType())),
])

VERDICT = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("payload", T.StringType()),
])

API_RECORD = T.StructType([
    T.StructField("is_attack", T.BooleanType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("model", T.StringType()),
    T.StructField("attack_type", T.StringType()),
])
