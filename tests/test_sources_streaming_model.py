"""S1, S2, S4, W1-W3, T1-T5, T7, T8."""
import os
import tempfile
import datetime as dt

from pyspark.sql import functions as F


def test_read_labelled_lines_files(spark):
    d = tempfile.mkdtemp(prefix="rs-lines-")
    with open(os.path.join(d, "attack.txt"), "w") as f:
        f.write("Attack list\n\n1. SQL Injection: id=1 OR 1=1\n 2. XSS: <b>: x \n\nno separator here\n")
    with open(os.path.join(d, "normal.txt"), "w") as f:
        f.write("h1\nh2\n1. Search: q=a\n")
    from reqsight.sources.readers import read_labelled_lines
    rows = sorted((os.path.basename(r.src), r.title, r.payload) for r in read_labelled_lines(spark, d).collect())
    assert rows == [("attack.txt", "", "no separator here"), ("attack.txt", "1. SQL Injection", "id=1 OR 1=1"),
                    ("attack.txt", "2. XSS", "<b>: x"), ("normal.txt", "1. Search", "q=a")]


def test_read_request_log_skips_long_rows(spark):
    d = tempfile.mkdtemp(prefix="rs-log-")
    with open(os.path.join(d, "log.csv"), "w") as f:
        f.write("http_method;http_path;http_query;rule_names\nGET;/a;x=1;r1\nPOST;/b\nGET;/c;q;r2;EXTRA\n")
    from reqsight.sources.readers import read_request_log
    rows = [tuple(r) for r in read_request_log(spark, d).collect()]
    assert rows == [("GET", "/a", "x=1", "r1"), ("POST", "/b", None, None)]


def _requests(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 0, 10), "q=hello"), (2, dt.datetime(2024, 1, 1, 0, 20), "<script>"),
            (3, dt.datetime(2024, 1, 1, 1, 5), "../../etc/passwd"), (4, dt.datetime(2024, 1, 1, 2, 30), ""),
            (5, dt.datetime(2024, 1, 1, 0, 40), "x UNION SELECT 1")]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, payload string")


def test_score_stream_equals_batch(spark):
    from reqsight.streaming.jobs import score_requests, score_stream
    d = tempfile.mkdtemp(prefix="rs-w1-")
    df = _requests(spark)
    df.repartition(3).write.parquet(f"{d}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    q = score_stream(stream, f"{d}/out", f"{d}/ckpt")
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{d}/out").select("event_id", "status", "type").collect())
    exp = sorted(tuple(r) for r in score_requests(df).select("event_id", "status", "type").collect())
    assert got == exp
    assert dict((r[0], r[1]) for r in got) == {1: "NORMAL", 2: "ATTACK", 3: "ATTACK", 4: "ERROR", 5: "ATTACK"}


def test_attack_rate_late_rows_dropped(spark):
    """Hour windows, 30 min delay: a row for 00:xx arriving after the watermark passed 01:30 is dropped."""
    from reqsight.streaming.jobs import attack_rate, score_requests
    d = tempfile.mkdtemp(prefix="rs-w2-")
    b1 = [(1, dt.datetime(2024, 1, 1, 0, 10), "q=a"), (2, dt.datetime(2024, 1, 1, 0, 20), "<script>")]
    b2 = [(3, dt.datetime(2024, 1, 1, 2, 0), "q=b")]                     # moves watermark to 01:30
    b3 = [(4, dt.datetime(2024, 1, 1, 0, 50), "<svg>"), (5, dt.datetime(2024, 1, 1, 3, 0), "q=c")]
    schema = "event_id long, ts timestamp, payload string"
    os.makedirs(f"{d}/in")
    stream = spark.readStream.schema(schema).parquet(f"{d}/in")
    agg = attack_rate(score_requests(stream), "1 hour", delay="30 minutes")
    q = agg.writeStream.outputMode("update").format("memory").queryName("w2t").start()
    for i, b in enumerate((b1, b2, b3)):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
        q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT window.start AS s, type, max(requests) AS r, max(attacks) AS a FROM w2t GROUP BY 1, 2").collect()
    res = {(r.s.hour, r.type): (r.r, r.a) for r in got}
    assert res[(0, "normal")] == (1, 0) and res[(0, "xss")] == (1, 1)   # late <svg> row not counted
    assert (2, "normal") in res and (3, "normal") in res


def test_collect_training_rows_idempotent(spark):
    from reqsight.streaming.jobs import collect_training_rows
    d = tempfile.mkdtemp(prefix="rs-w3-")
    df = _requests(spark)
    df.write.parquet(f"{d}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{d}/in")
    collect_training_rows(stream, f"{d}/t", f"{d}/ck").awaitTermination()
    t = spark.read.parquet(f"{d}/t")
    assert t.count() == 5 and set(t.columns) >= {"text", "label_str", "batch_id"}


def test_train_score_save_load(spark):
    from reqsight.operators.model import (TrainConfig, load_model, save_model, score, select_best,
                                          train_and_evaluate)
    rows = []
    for i in range(600):
        k = i % 3
        txt = ["q=hello world page", "<script>alert(1)</script>", "1 union select pass from users"][k]
        rows.append((i, f"{txt} {i % 7}", k, i % 60))
    df = spark.createDataFrame(rows, "id long, text string, label int, tid int")
    cfg = TrainConfig(num_features=1 << 12, max_iter=20, group_col="tid")
    model, metrics, report, scored = train_and_evaluate(spark, df, cfg)
    assert metrics["accuracy"] > 0.9
    d = tempfile.mkdtemp(prefix="rs-model-")
    save_model(model, d, cfg, metrics, version="v1")
    m2, meta = load_model(d)
    assert meta["version"] == "v1" and meta["classes"][0] == "normal"
    a = score(df.limit(20), model).select("id", "pred").collect()
    b = score(df.limit(20), m2).select("id", "pred").collect()
    assert a == b
    best, params, results = select_best(df, [{"reg_param": 0.0}, {"reg_param": 0.1}], cfg)
    assert len(results) == 2 and params in ({"reg_param": 0.0}, {"reg_param": 0.1})


def test_majority_vote_and_retrain_rows(spark):
    from reqsight.operators.model import majority_vote, retrain_rows
    longs = spark.createDataFrame([(1, "a", 2), (1, "b", 2), (1, "c", 3), (2, "a", 5), (2, "b", 4)],
                                  "id long, model string, pred int")
    got = {r.id: (r.vote, r.votes, r.voters) for r in majority_vote(longs).collect()}
    assert got == {1: (2, 2, 3), 2: (4, 1, 2)}
    base = spark.createDataFrame([("known",)], "text string")
    new = spark.createDataFrame([("known", "xss"), ("new", "sqli"), ("new", "sqli")], "text string, label_str string")
    hn = spark.createDataFrame([("fp",)], "text string")
    assert sorted(tuple(r) for r in retrain_rows(base, new, hn).collect()) == [("fp", "normal"), ("new", "sqli")]


def test_attack_rate_sliding_windows_batch(spark):
    """1-hour windows sliding every 30 minutes: a 00:40 row is in [00:00,01:00) and [00:30,01:30)."""
    from reqsight.streaming.jobs import attack_rate, score_requests, window_start_text
    df = score_requests(_requests(spark))
    got = attack_rate(df, "1 hour", slide="30 minutes", delay=None) \
        .select(window_start_text("window").alias("s"), "type", "requests", "attacks").collect()
    res = {(r.s[11:16], r.type): (r.requests, r.attacks) for r in got}
    assert res[("00:00", "sqli")] == (1, 1) and res[("00:30", "sqli")] == (1, 1)
    assert res[("00:00", "normal")] == (1, 0) and ("00:30", "normal") not in res
    assert res[("00:00", "xss")] == (1, 1) and res[("23:30", "xss")] == (1, 1)
    assert res[("02:00", None)] == (1, 0) and res[("02:30", None)] == (1, 0)   # empty payload: ERROR, no type


def test_stratified_split_rejects_tiny_class(spark):
    import pytest
    from reqsight.operators.sampling import stratified_split
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, label int")
    with pytest.raises(Exception, match="fewer than 2 rows"):
        stratified_split(df, "label", "id").collect()


def test_mlp_option_trains_and_scores(spark):
    from reqsight.operators.model import TrainConfig, score, train_classifier
    rows = [(i, ["q=hello world", "<script>alert(1)</script>"][i % 2] + f" {i % 5}", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    m = train_classifier(df, TrainConfig(model="mlp", num_features=256, hidden=[16], max_iter=50))
    s = score(df, m).select("label", "pred", "probs").collect()
    assert sum(r.label == r.pred for r in s) / len(s) > 0.9
    assert all(len(r.probs) == 8 for r in s)


def test_samples_csv_round_trip(spark):
    from reqsight.sources.readers import drop_null_samples, read_samples, write_samples
    d = tempfile.mkdtemp(prefix="rs-csv-")
    rows = [("a,b \"quoted\"\nsecond line", "xss", 2), ("plain", "normal", 0), ("", "other", 5)]
    df = spark.createDataFrame(rows, "text string, label_str string, label int")
    write_samples(df, f"{d}/s", fmt="csv", partition_by=None)
    back = read_samples(spark, f"{d}/s", fmt="csv")
    got = [tuple(r) for r in back.collect()]
    assert ("a,b \"quoted\"\nsecond line", "xss", 2) in got and ("plain", "normal", 0) in got
    assert (None, "other", 5) in got and len(got) == 3         # Q27: only an empty field reads as NULL
    assert drop_null_samples(back.select("text", "label")).count() == 2


def test_score_stream_with_trained_model(spark):
    """W1 with T5 as the scorer: the Spark ML pipeline runs inside the micro-batches."""
    from reqsight.operators.model import TrainConfig, score, train_classifier
    from reqsight.streaming.jobs import score_stream
    rows = [(i, ["q=hello world", "<script>alert(1)</script>"][i % 2] + f" {i % 5}", [0, 2][i % 2]) for i in range(200)]
    model = train_classifier(spark.createDataFrame(rows, "id long, text string, label int"),
                             TrainConfig(num_features=1 << 10, max_iter=20))
    d = tempfile.mkdtemp(prefix="rs-w1m-")
    reqs = spark.createDataFrame([(1, "q=hello world 3"), (2, "<script>alert(1)</script> 1"), (3, "")],
                                 "event_id long, payload string")
    reqs.write.parquet(f"{d}/in")
    stream = spark.readStream.schema(reqs.schema).parquet(f"{d}/in")
    scorer = lambda df: score(df.withColumn("text", F.col("payload")), model).drop("text")
    score_stream(stream, f"{d}/out", f"{d}/ck", scorer=scorer).awaitTermination()
    got = {r.event_id: (r.status, r.type) for r in spark.read.parquet(f"{d}/out").collect()}
    assert got[1] == ("NORMAL", "normal") and got[2] == ("ATTACK", "xss") and got[3] == ("ERROR", None)


def test_normalise_stage_travels_with_the_model(spark):
    from reqsight.operators.model import TrainConfig, load_model, save_model, score, train_classifier
    rows = [(i, ["q=hello world", "<script>alert(1)</script>"][i % 2] + f" {i % 5}", [0, 2][i % 2]) for i in range(200)]
    cfg = TrainConfig(num_features=1 << 10, max_iter=20, normalise=True)
    model = train_classifier(spark.createDataFrame(rows, "id long, text string, label int"), cfg)
    d = tempfile.mkdtemp(prefix="rs-norm-")
    save_model(model, d, cfg, version="v1")
    loaded, _ = load_model(d)
    probe = spark.createDataFrame([(1, "%253Cscript%253Ealert(1)%253C%252Fscript%253E 3"), (2, "q=HELLO%20world 1")],
                                  "id long, text string")
    got = {r.id: r.type for r in score(probe, loaded).collect()}
    assert got == {1: "xss", 2: "normal"}


def test_hard_negatives_overrule_log_labels(spark):
    from reqsight.operators.model import false_alarms, retrain_rows
    judged = spark.createDataFrame([(1, "menu select", 0, 1, 0.9), (2, "menu select", 0, 1, 0.9), (3, "known", 0, 2, 0.8), (4, "1 or 1=1", 1, 1, 0.9),
                                    (5, "fine", 0, 0, 0.9), (6, "unsure", 0, 1, 0.4)], "id int, text string, label int, pred int, confidence double")
    logs = spark.createDataFrame([("menu select", "sqli"), ("1 or 1=1", "sqli"), ("1 or 1=1", "sqli"), ("known", "xss"), (None, "rce")], "text string, label_str string")
    base = spark.createDataFrame([("known",)], "text string")
    got = {tuple(r) for r in retrain_rows(base, logs, false_alarms(judged, min_conf=0.5)).collect()}
    assert got == {("menu select", "normal"), ("1 or 1=1", "sqli"), (None, "rce")}
    assert {r.text for r in false_alarms(judged, k=1).collect()} == {"menu select"}


def test_closed_windows_come_once_and_late_rows_are_dropped(spark, tmp_path):
    from reqsight.streaming.jobs import attack_rate, closed_windows
    inbox, table = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp, type string, status string"
    dropped = 0
    for days in ([1, 1, 2], [5], [1, 5, 4], [9]):  # of the third delivery day 1 is late, day 4 within the day allowed
        rows = [(f"2024-01-{d:02d} 12:00:00+00:00", "xss", "ATTACK") for d in days]
        spark.createDataFrame(rows, "ts string, type string, status string").selectExpr("cast(ts AS timestamp) ts", "type", "status").write.mode("append").parquet(inbox)
        rates = attack_rate(spark.readStream.schema(schema).parquet(inbox), "1 day", delay="1 day")
        q = closed_windows(rates, table, str(tmp_path / "ckpt"))
        q.awaitTermination()
        dropped += sum(o.numRowsDroppedByWatermark for p in q.recentProgress for o in p.stateOperators)
        assert q.lastProgress.stateOperators[0].numRowsTotal <= 2  # closed windows leave the state
    got = spark.read.schema(rates.schema).parquet(table).selectExpr("unix_seconds(window.start) div 86400 - 19722 AS day", "requests", "attacks").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 2), (2, 1, 1), (4, 1, 1), (5, 2, 2)] and dropped == 1


def test_char_ngrams_brute_force(spark):
    from collections import Counter
    from reqsight.operators.model import char_ngram_features
    texts = [None, "", "ab", "abc", "aaaaaa", "ÄäÖ 😀😀😀 ä", "select select"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in char_ngram_features(df, "text", 3, 1 << 18).collect():
        t = (texts[r.id] or "").lower()
        want = Counter(t[i:i + 3] for i in range(len(t) - 2))
        assert (r.n_grams, r.n_distinct) == (sum(want.values()), len(want))
        assert sorted(r.counts.values) == sorted(want.values())


def test_training_partitions_follow_the_rows_not_the_files(spark):
    """Each pass of the optimiser makes a dense gradient per partition, so few training rows must lie in few."""
    from reqsight.operators.model import TrainConfig, fit_features, training_partitions
    df = spark.range(0, 400, 1, 50).select(F.concat(F.lit("q="), F.col("id").cast("string")).alias("text"), (F.col("id") % 2).cast("int").alias("label"))
    _, features = fit_features(df, TrainConfig(num_features=1 << 12))
    assert features.rdd.getNumPartitions() == 16 and features.count() == 400
    cfg = TrainConfig(num_features=1 << 15)
    assert [training_partitions(v, cfg) for v in (0, 10 ** 7, 10 ** 9)] == [16, 16, 119]


def test_score_many_scores_once(spark):
    """the long form is written once; the votes are counted from it and never score again."""
    from reqsight.operators.model import TrainConfig, score_many, train_classifier
    df = spark.createDataFrame([(i, ["hello world", "<script>x", ""][i % 3], i % 3) for i in range(30)], "id long, text string, label int")
    models = {f"m{n}": train_classifier(df, TrainConfig(ngram=n, max_iter=3, num_features=1 << 8)) for n in (1, 2)}
    longs, votes = score_many(df, models)
    assert "UDF" not in longs._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in votes._jdf.queryExecution().optimizedPlan().toString()
    assert longs.count() == 60 and votes.count() == 30


def test_files_of_labelled_lines_follow_the_bytes(spark, tmp_path, monkeypatch):
    """few, long lines are dealt to files by their bytes too, a file to a task; the lines read back are the same."""
    from reqsight.plans import queries as Q
    texts = [(i, f"t{i % 3}: " + "x" * 500 + f"\nline {i}") for i in range(200)] + [(900, None), (901, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    written = []
    from reqsight.sources import readers
    read = readers.read_labelled_lines

    def seen(s, paths, skip=2):
        written.extend(sorted(r.n for r in s.read.text(paths).groupBy(F.input_file_name().alias("f")).agg(F.sum(F.length("value")).alias("n")).collect()))
        return read(s, paths, skip)

    monkeypatch.setattr(readers, "read_labelled_lines", seen)
    monkeypatch.setattr(Q, "BYTES_PER_FILE", 4000)
    rows = {(r.title, r.payload): r.n for r in Q.q_s1_files(spark, str(tmp_path)).collect()}
    assert sum(rows.values()) == 400 and sum(n for (t, _), n in rows.items() if t == "t0") == 67
    assert len(written) == 26 and max(written) < 12000


def test_ngram_vectors_are_those_of_the_stages(spark):
    """texts are hashed many at a time; every vector is the one that the saved pipeline's own stages make."""
    import random
    from reqsight.functions.ngrams import add_ngram_vectors
    from reqsight.operators.model import char_ngram_stages
    rnd = random.Random(5)
    texts = [None, "", "a", "ab", "\u0130", "AB\u03a3", "x" * 200000 + "\u00e9"]
    texts += ["".join(rnd.choice("abcAB ';\u00c4\u00e9\u03a3\u6f22\U0001f600\U00010400\u0301\n\x00") for _ in range(rnd.randrange(300))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    for n, features, binary in ((1, 1 << 10, True), (2, 1000, False), (3, 1 << 15, True), (3, 1 << 18, False), (5, 77, True)):
        d = df
        for stage in char_ngram_stages("text", "o", n, features, idf=False, binary=binary):
            d = stage.transform(d)
        rows = add_ngram_vectors(d, "text", {"v": (n, features, binary)}).select("o", "v").collect()
        assert len(rows) == len(texts) and all(r.o == r.v for r in rows)


def test_a_loaded_model_scores_many_texts_at_a_time(spark, tmp_path):
    """F1: neither the trained nor the loaded model runs the n-gram lambdas; the scores are those of the pipeline itself."""
    from pyspark.ml.functions import vector_to_array
    from reqsight.operators.model import TrainConfig, load_model, save_model, score, train_classifier
    rows = [(i, None if i % 9 == 4 else ["q=hello w\u00f6rld", "<script>alert(1)</script>"][i % 2] + f" {i % 5}", [0, 2][i % 2]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    for cfg in (TrainConfig(num_features=1 << 10, max_iter=5), TrainConfig(num_features=300, ngram=2, max_iter=5, binary=False, normalise=True)):
        model = train_classifier(df, cfg)
        save_model(model, str(tmp_path), cfg, version="v1")
        want = {r.id: r.p for r in model.transform(df).select("id", vector_to_array("probability").alias("p")).collect()}
        for m in (model, load_model(str(tmp_path))[0]):
            s = score(df, m)
            assert "xxhash64" not in s._jdf.queryExecution().optimizedPlan().toString()
            assert {r.id: r.probs for r in s.collect()} == want
            assert s.columns == ["id", "text", "label", "probs", "logits", "pred", "type", "confidence"]


def test_score_many_reads_the_texts_once(spark, monkeypatch):
    """one pass over the texts serves all models; each gives what it gives alone, for missing and repeated keys too."""
    from reqsight.operators import model as O
    rows = [(None if i == 7 else i % 25, None if i % 9 == 4 else ["hello w\u00f6rld", "<script>x", ""][i % 3] + f" {i % 4}", i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    cfgs = [O.TrainConfig(ngram=1, max_iter=3, num_features=1 << 8), O.TrainConfig(ngram=2, max_iter=3, num_features=100, binary=False),
            O.TrainConfig(ngram=2, max_iter=3, num_features=1 << 8, normalise=True), O.TrainConfig(max_iter=3, num_features=64, model="mlp", hidden=[4])]
    models = {f"m{i}": O.train_classifier(df, c) for i, c in enumerate(cfgs)}
    plans, kept = [], O.reliable_checkpoint
    monkeypatch.setattr(O, "reliable_checkpoint", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or kept(d))
    longs, votes = O.score_many(df.select("id", F.col("text").alias("line")), models, text="line")
    assert longs.columns == ["id", "model", "pred", "confidence"] and "Union" not in plans[0]
    assert plans[0].count("ArrowEvalPython [") == 1
    want = [(r.id, name, r.pred, r.confidence) for name, m in models.items() for r in O.score(df, m).collect()]
    assert sorted(map(str, map(tuple, longs.collect()))) == sorted(map(str, want))
    assert votes.agg(F.sum("voters")).first()[0] == 4 * len(rows)
