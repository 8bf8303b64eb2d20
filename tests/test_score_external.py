"""ONNX scoring over Arrow batches with predict_batch_udf, including the failure path."""
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from onnx_tiny import write_linear_model
from reqsight.functions.encode import encode_cls_chars, DEMO_CHAR_VOCAB
from reqsight.fixed import CLASSES
from reqsight.operators.model import score_external


def test_score_external_matches_numpy_and_fails_closed(spark):
    d = tempfile.mkdtemp(prefix="rs-onnx-")
    w = np.random.RandomState(3).randn(128, 8).astype(np.float32) / 1000
    good, bad = os.path.join(d, "good.onnx"), os.path.join(d, "bad.onnx")
    write_linear_model(good, w)
    write_linear_model(bad, w, input_name="ids")        # wrong input name: every batch fails
    texts = ["q=hello", "<script>alert(1)</script>", "../../etc/passwd", "x" * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    enc = df.withColumn("e", encode_cls_chars("text", DEMO_CHAR_VOCAB)) \
        .select("id", F.col("e.ids").alias("ids"), F.col("e.mask").alias("mask"))
    rows = sorted(score_external(enc, good, batch_size=2).collect(), key=lambda r: r.id)
    for r in rows:
        exp = np.asarray(r.ids, dtype=np.float32) @ w
        assert np.allclose(r.logits, exp, atol=1e-3)
        assert r.pred == int(np.argmax(exp)) and r.type == CLASSES[r.pred]
        assert abs(sum(r.probs) - 1) < 1e-9
    from reqsight.operators.evaluate import latency_summary
    lat = latency_summary(score_external(enc, good, batch_size=2), "elapsed").first()
    assert lat.n == 4 and lat.mean > 0 and lat.p50 <= lat.p99
    failed = score_external(enc, bad).select("type", "pred").collect()
    assert {r.type for r in failed} == {"error"} and all(r.pred is None for r in failed)
