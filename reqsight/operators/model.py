"""Training and scoring (E4, T1-T5, T7, T8) with Spark ML.

No neural weights ship with the reference, so the classifier is a different
model for the same task: character n-grams hashed into a sparse vector,
IDF-weighted, fed to multinomial logistic regression (or a small MLP).
Training, scoring and evaluation are all distributed Spark ML / SQL jobs.
"""

from __future__ import annotations

import json
import re
import sys
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

from pyspark import cloudpickle
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, HashingTF, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from reqsight.fixed import CAP_PER_CLASS, CLASSES, DEFAULT_SEED, NUM_CLASSES, TEST_FRACTION
from reqsight.functions.decide import argmax, softmax
from reqsight.functions.ngrams import add_ngram_vectors
from reqsight.functions.rules import label_name
from reqsight.operators import evaluate as A
from reqsight.functions.draws import draw
from reqsight.operators.sampling import cap_per_class, class_cuts, hard_negatives, random_split, row_hash, stratified_split
from reqsight.session import reliable_checkpoint


# Worker-side functions of this module travel by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class TrainConfig:
    ngram: int = 3
    num_features: int = 1 << 16
    model: str = "logreg"             # or "mlp"
    max_iter: int = 50
    reg_param: float = 0.001
    elastic_net: float = 0.0
    binary: bool = True               # presence of n-grams, not counts: long texts do not drown a short marker
    standardize: bool = False         # scaling by deviation would favour the rarest n-grams
    hidden: list = field(default_factory=lambda: [64])
    cap: int = CAP_PER_CLASS
    test: float = TEST_FRACTION
    split: str = "random"             # "random" or "stratified"
    group_col: str | None = None      # e.g. "tid": keep a template's variants on one side
    seed: int = DEFAULT_SEED
    text_col: str = "text"
    label_col: str = "label"
    key_col: str = "id"
    grid: list = field(default_factory=list)  # T2 inside T3: candidate settings, e.g. [{"reg_param": 0.01}]
    steps: list = field(default_factory=list)  # T2: iteration counts whose models are compared, e.g. [5, 10, 20, 50]
    normalise: bool = False           # P6 inside the pipeline: URL-decode at any depth, then lower-case


def _ngram_statement(text: str, n: int) -> str:
    window = ", ".join(f"c[i + {k}]" for k in range(n))
    chars = f"if(`{text}` = '', CAST(array() AS array<string>), split(lower(`{text}`), ''))"  # an empty text splits into one empty character
    return (f"SELECT *, transform(array({chars}), c -> CASE WHEN size(c) >= {n} THEN "
            f"transform(sequence(0, size(c) - {n}), i -> xxhash64({window})) ELSE cast(array() AS array<bigint>) END)[0] AS _grams FROM __THIS__")


def char_ngram_stages(text: str = "text", out: str = "features", n: int = 3,
                      num_features: int = 1 << 18, idf: bool = True, binary: bool = False) -> list:
    """Lower-cased characters -> n-grams -> hashed term frequencies -> IDF.

    An n-gram is the 64-bit hash of ``n`` neighbouring characters (code points), taken in one pass over the characters:
    no n-gram string is built, and the characters are split once. ``binary`` counts an n-gram once per text.
    """
    grams = SQLTransformer(statement=_ngram_statement(text, n))
    stages = [grams, HashingTF(inputCol="_grams", outputCol="_tf" if idf else out, numFeatures=num_features, binary=binary)]
    if idf:
        stages.append(IDF(inputCol="_tf", outputCol=out))
    return stages


def _hashed_ngrams(stages: list[Transformer]) -> tuple[str, str, tuple[int, int, bool]] | None:
    """(text column, output column, (n, features, binary)) if the first two stages are E4's n-grams and their hashing."""
    grams, tf = [*stages[:2], None, None][:2]
    told = isinstance(grams, SQLTransformer) and re.search(r"split\(lower\(`(.*)`\), ''\).* size\(c\) >= (\d+) ", grams.getStatement())
    if not told or grams.getStatement() != _ngram_statement(told[1], int(told[2])) or not isinstance(tf, HashingTF) or tf.getInputCol() != "_grams":
        return None
    return told[1], tf.getOutputCol(), (int(told[2]), tf.getNumFeatures(), tf.getBinary())


def apply_stages(df: DataFrame, stages: list[Transformer]) -> DataFrame:
    """``df`` transformed by each stage in turn; E4's n-grams and their hashing, of this session's or a loaded model's, are
    counted many texts at a time (``add_ngram_vectors``): the same vectors, without ``_grams``."""
    while stages:
        if found := _hashed_ngrams(stages):
            text, out, kind = found
            df, stages = add_ngram_vectors(df, text, {out: kind}), stages[2:]
        else:
            df, stages = stages[0].transform(df), stages[1:]
    return df


def _stages(model: Transformer) -> list[Transformer]:
    return model.stages if isinstance(model, PipelineModel) else [model]


def char_ngram_features(df: DataFrame, text: str = "text", n: int = 3,
                        num_features: int = 1 << 18) -> DataFrame:
    """E4 as a transformation: adds ``n_grams``, ``n_distinct`` (different n-grams), ``counts`` (hashed term frequencies)
    and ``features`` (with IDF). The counts are written once and serve both the fit of the IDF and its application."""
    *counting, idf = char_ngram_stages(text, "features", n, num_features)
    counted = df
    for stage in counting:
        counted = stage.transform(counted)
    counted = reliable_checkpoint(counted.select(
        *df.columns, F.size("_grams").cast("bigint").alias("n_grams"),
        F.size(F.array_distinct("_grams")).cast("bigint").alias("n_distinct"), "_tf"))
    return idf.fit(counted).transform(counted).withColumnRenamed("_tf", "counts")


def normalise_stage(text: str = "text", out: str = "_norm") -> SQLTransformer:
    """P6 as a pipeline stage, so a saved model normalises its input the same way when scoring."""
    once = "regexp_replace(acc.text, '%(25)+([0-9A-Fa-f]{2})', '%$2')"
    once = f"try_url_decode(regexp_replace({once}, '%(?![0-9A-Fa-f]{{2}})', '%25'))"
    again = f"transform(array({once}), n -> named_struct('text', n, 'done', n <=> acc.text))[0]"
    full = (f"aggregate(sequence(1, length(`{text}`) - length(replace(`{text}`, '%', '')) + 2), named_struct('text', `{text}`, 'done', false), "
            f"(acc, i) -> if(acc.done, acc, {again}), acc -> acc.text)")
    return SQLTransformer(statement=f"SELECT *, lower(if(contains(`{text}`, '%'), {full}, replace(`{text}`, '+', ' '))) AS {out} FROM __THIS__")


def _estimator(cfg: TrainConfig):
    if cfg.model == "mlp":
        return MultilayerPerceptronClassifier(featuresCol="features", labelCol="_y", maxIter=cfg.max_iter,
                                              layers=[cfg.num_features, *cfg.hidden, NUM_CLASSES],
                                              seed=cfg.seed)
    return LogisticRegression(featuresCol="features", labelCol="_y", family="multinomial",
                              maxIter=cfg.max_iter, regParam=cfg.reg_param,
                              elasticNetParam=cfg.elastic_net, standardization=cfg.standardize)


def _labelled(samples: DataFrame, cfg: TrainConfig) -> DataFrame:
    return samples.select(F.col(cfg.text_col).alias("text"), F.col(cfg.label_col).cast("double").alias("_y"))


#: An estimator's partition holds so many times the values of one dense gradient (features x classes), and so many values at least.
GRADIENTS_PER_PARTITION, VALUES_PER_PARTITION = 32, 1 << 20
#: So few partitions are never made fewer: they cost little and keep the cores busy.
FEW_PARTITIONS = 16


def training_partitions(values: int, cfg: TrainConfig) -> int:
    """Partitions for training rows of so many non-zero features, whatever tables they were chosen from.

    Every pass of an optimiser makes one dense gradient per partition and sends some to the driver, so partitions follow
    the rows that are trained on: rows capped per class stay in as many, however many files they come from.
    """
    return max(FEW_PARTITIONS, values // max(GRADIENTS_PER_PARTITION * cfg.num_features * NUM_CLASSES, VALUES_PER_PARTITION))


def fit_features(train: DataFrame, cfg: TrainConfig) -> tuple[list, DataFrame]:
    """E4 fitted on ``text, label``: its stages, and the training rows as (_y, features).

    The hashed counts are written once: the IDF fit and every pass of an estimator read them, never the texts again.
    The rows lie in ``training_partitions`` at most; the IDF's document frequencies add up to their non-zero features.
    """
    pre = [normalise_stage("text", "_norm")] if cfg.normalise else []
    *counting, idf = char_ngram_stages("_norm" if cfg.normalise else "text", "features", cfg.ngram, cfg.num_features, binary=cfg.binary)
    counted = reliable_checkpoint(apply_stages(_labelled(train, cfg), pre + counting).select("_y", "_tf"))
    fitted = idf.fit(counted)
    features = fitted.transform(counted).select("_y", "features")
    return [*pre, *counting, fitted], features.coalesce(training_partitions(sum(fitted.docFreq), cfg))


def train_classifier(train: DataFrame, cfg: TrainConfig | None = None) -> PipelineModel:
    """Fit E4 + classifier on ``text, label``."""
    cfg = cfg or TrainConfig()
    stages, features = fit_features(train, cfg)
    return PipelineModel(stages=[*stages, _estimator(cfg).fit(features)])


def _decided(out: DataFrame) -> DataFrame:
    """``logits, probs, pred, type, confidence`` of a classifier's output."""
    logits = vector_to_array(F.col("rawPrediction")) if "rawPrediction" in out.columns else None
    probs = vector_to_array(F.col("probability"))
    out = out.withColumn("probs", probs)
    out = out.withColumn("logits", logits if logits is not None else F.transform("probs", F.log))
    out = out.withColumn("pred", argmax("logits"))
    return out.withColumn("type", label_name("pred")).withColumn("confidence", F.element_at("probs", F.col("pred") + 1))


def score(df: DataFrame, model: PipelineModel, text: str = "text") -> DataFrame:
    """T5: adds ``logits, probs, pred, type, confidence`` (arrays of 8 doubles)."""
    d = df.withColumn("text", F.col(text)) if text != "text" else df
    out = _decided(apply_stages(d, _stages(model)))
    internal = {"_norm", "_grams", "_tf", "features", "rawPrediction", "probability", "prediction"}
    drop = [c for c in out.columns if c in internal and c not in df.columns]
    return out.drop(*drop)


def explode_confidences(df: DataFrame, probs: str = "probs", keep: list[str] | None = None) -> DataFrame:
    """One row per (input, class) with the class id, its name and its probability."""
    keep = keep if keep is not None else [c for c in df.columns if c != probs]
    return (df.select(*keep, F.posexplode(probs).alias("class_id", "prob"))
            .withColumn("class", label_name("class_id")))


def group_split(samples: DataFrame, label: str, group: str, test: float, seed: int) -> DataFrame:
    """Whole groups to one side, stratified: a group belongs to its commonest label, and of each label's groups
    round(test * n), one at least if there are two, are ``test``."""
    sizes = samples.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    of = sizes.groupBy(group).agg(F.max_by(F.col(label), F.struct("_n", label)).alias("_gl"))
    order = draw(F.col(group), "split", seed)

    def take(n):
        k = F.round(n * F.lit(test)).cast("bigint")
        return F.when(n < 2, F.lit(0)).otherwise(F.least(n - 1, F.greatest(F.lit(1), k)))

    cuts = class_cuts(of, "_gl", group, order, take)
    held = (of.join(F.broadcast(cuts), F.col("_gl") == F.col("_cl"))  # one row per class
            .filter(F.struct(order.alias("_d"), F.col(group), row_hash(of)) <= F.col("_cut")).select(F.col(group).alias("_held")))
    marked = samples.join(held, F.col(group) == F.col("_held"), "left")
    return marked.withColumn("split", F.when(F.col("_held").isNull(), F.lit("train")).otherwise(F.lit("test"))).drop("_held")


def split_dataset(samples: DataFrame, cfg: TrainConfig) -> DataFrame:
    if cfg.group_col:
        return group_split(samples, cfg.label_col, cfg.group_col, cfg.test, cfg.seed)
    if cfg.split == "stratified":
        return stratified_split(samples, cfg.label_col, cfg.key_col, cfg.test, cfg.seed)
    return random_split(samples, cfg.key_col, cfg.test, cfg.seed)


#: Candidates fitted at the same time, as jobs of one session.
PARALLEL_CANDIDATES = 4


def select_best(train: DataFrame, grid: list[dict], cfg: TrainConfig | None = None, metric: str = "f1",
                patience: int = 2) -> tuple[PipelineModel, dict, list]:
    """Fit every candidate on a seeded split of ``train`` and keep the best weighted ``metric`` on the held-out rows.

    With ``cfg.steps`` each candidate is measured after each of these numbers of iterations (the optimiser is
    deterministic, so a shorter run is a prefix of a longer one) until ``patience`` steps in a row bring nothing, and the
    best step of the best candidate is kept. Features are fitted and written once for all candidates that share their
    settings; candidates run side by side. Ties go to the earlier candidate and step.
    """
    cfg = cfg or TrainConfig()
    base = replace(cfg, grid=[], steps=[])
    parts = reliable_checkpoint(split_dataset(train.drop("split"), replace(cfg, seed=cfg.seed + 1)))
    fit_part, val_part = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    shared: dict = {}
    for params in grid:
        c = replace(base, **params)
        kind = (c.ngram, c.num_features, c.binary, c.normalise)
        if kind not in shared:
            stages, features = fit_features(fit_part, c)
            held = apply_stages(_labelled(val_part, c), stages)
            shared[kind] = stages, reliable_checkpoint(features), reliable_checkpoint(held.select("_y", "features"))

    def curve(params: dict) -> list:
        c, out, worse, top = replace(base, **params), [], 0, None
        stages, features, held = shared[c.ngram, c.num_features, c.binary, c.normalise]
        for step in cfg.steps or [c.max_iter]:
            m = _estimator(replace(c, max_iter=step)).fit(features)
            s = m.transform(held).select(F.col("_y").cast("int").alias("label"), argmax(vector_to_array(F.col("probability"))).alias("pred"))
            value = A.weighted_prf(s, "label", "pred").first()[metric]
            chosen = {**params, "max_iter": step} if cfg.steps else params
            out.append(({"params": chosen, metric: value}, PipelineModel(stages=[*stages, m])))
            worse, top = (0, value) if top is None or value > top else (worse + 1, top)
            if worse >= patience:
                break
        return out

    with ThreadPoolExecutor(PARALLEL_CANDIDATES) as pool:
        tried = [x for one in pool.map(curve, grid) for x in one]
    best = max(tried, key=lambda x: x[0][metric])
    return best[1], best[0]["params"], [x[0] for x in tried]


def train_and_evaluate(spark: SparkSession, samples: DataFrame, cfg: TrainConfig | None = None,
                       checkpoint: bool = True):
    """Split -> cap the training rows per class -> select the settings (T2, if there is a grid) ->
    train -> score all held-out rows -> weighted P/R/F1 and report.

    The split samples (typically the augmented dataset, an expensive lineage) are written once to the
    shared folder, so training passes never recompute the augmentation, and a lost executor re-reads the
    checkpoint instead. Returns (model, metrics as dict, report DataFrame, scored test DataFrame); the settings
    that were used, T2's choice among them, are in ``metrics["config"]``.
    """
    cfg = cfg or TrainConfig()
    keep = list(dict.fromkeys([cfg.key_col, cfg.text_col, cfg.label_col, *([cfg.group_col] if cfg.group_col else [])]))
    data = samples.select(*keep)
    parts = split_dataset(reliable_checkpoint(data) if checkpoint else data, cfg)
    parts = reliable_checkpoint(parts) if checkpoint else parts
    train = cap_per_class(parts.filter(F.col("split") == "train"), cfg.label_col, cfg.key_col, cfg.cap, cfg.seed)
    train = reliable_checkpoint(train) if checkpoint else train  # a capped part: T2 and T1 never read the whole split again
    if cfg.grid or cfg.steps:
        cfg = replace(cfg, **select_best(train, cfg.grid or [{}], cfg)[1], grid=[], steps=[])
    model = train_classifier(train, cfg)
    test = parts.filter(F.col("split") == "test")
    scored = score(test, model, cfg.text_col).withColumn("label", F.col(cfg.label_col).cast("int"))
    scored = scored.select(*keep, "split", "logits", "probs", "pred", "type", "confidence", *(["label"] if cfg.label_col != "label" else []))
    scored = reliable_checkpoint(scored) if checkpoint else scored
    metrics = {**A.weighted_prf(scored, "label", "pred").first().asDict(), "config": asdict(cfg)}
    report = A.classification_report(scored, "label", "pred")
    return model, metrics, report, scored


def save_model(model: PipelineModel, base: str, cfg: TrainConfig | None = None,
               metrics: dict | None = None, version: str | None = None) -> str:
    """T4: write ``base/<version>`` (Spark ML format) plus a JSON sidecar."""
    version = version or time.strftime("v%Y%m%d%H%M%S")
    path = f"{base.rstrip('/')}/{version}"
    model.write().overwrite().save(path)
    meta = {"version": version, "classes": CLASSES, "config": asdict(cfg or TrainConfig()),
            "metrics": metrics or {}}
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}_meta")
    return path


def load_model(base: str, version: str | None = None) -> tuple[PipelineModel, dict]:
    """T4: load a version (the latest when none is given) and its sidecar."""
    spark = SparkSession.getActiveSession()
    if version is None:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(base)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)
                       if s.isDirectory() and not s.getPath().getName().endswith("_meta"))
        version = names[-1]
    path = f"{base.rstrip('/')}/{version}"
    meta = json.loads(spark.read.text(f"{path}_meta").first()[0])
    return PipelineModel.load(path), meta


def score_many(df: DataFrame, models: dict[str, PipelineModel], key: str = "id",
               text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Long form ``key, model, pred, confidence`` and the majority vote per key.

    The long form is written once, so a text is scored once by a model whatever is made of the scores and votes. The texts are
    read once for all models, whose n-grams are counted in the same pass.
    """
    wide = df.select(F.col(key), *([F.col(text).alias("text")] if key != "text" else []))
    found = {f"_v{i}": x for i, m in enumerate(models.values()) if (x := _hashed_ngrams(_stages(m))) and x[0] == "text"}
    wide = add_ngram_vectors(wide, "text", {v: kind for v, (_, _, kind) in found.items()}) if found else wide
    for i, m in enumerate(models.values()):
        v, stages = f"_v{i}", _stages(m)
        out = apply_stages(wide.withColumn(found[v][1], F.col(v)), stages[2:]) if v in found else apply_stages(wide, stages)
        wide = _decided(out).select(*wide.columns, F.struct("pred", "confidence").alias(f"_s{i}"))
    said = [F.struct(F.lit(name).alias("model"), F.col(f"_s{i}.pred"), F.col(f"_s{i}.confidence")) for i, name in enumerate(models)]
    longs = wide.select(key, F.explode(F.array(*said)).alias("_s")).select(key, "_s.model", "_s.pred", "_s.confidence")
    longs = reliable_checkpoint(longs)
    return longs, majority_vote(longs, key)


def majority_vote(longs: DataFrame, key: str = "id", pred: str = "pred") -> DataFrame:
    """Most votes per key; ties go to the lowest class id. One partial aggregate, no window."""
    votes = longs.groupBy(key, pred).agg(F.count(F.lit(1)).alias("_n"))
    best = votes.groupBy(key).agg(F.max(F.struct(F.col("_n"), (-F.col(pred)).alias("_neg"))).alias("_b"),
                                  F.sum("_n").alias("voters"))
    return best.select(key, (-F.col("_b._neg")).cast("int").alias("vote"), F.col("_b._n").alias("votes"), "voters")


def false_alarms(scored: DataFrame, label: str = "label", pred: str = "pred", confidence: str = "confidence",
                 key: str = "id", min_conf: float = 0.0, k: int | None = None) -> DataFrame:
    """M7 as T8's input: true-normal rows that the current model calls an attack (all of them unless ``k`` is given)."""
    return hard_negatives(scored, label, pred, confidence, key, min_conf, k)


def retrain_rows(base: DataFrame, new_rows: DataFrame, hard_negatives: DataFrame | None = None,
                 text: str = "text", label: str = "label_str") -> DataFrame:
    """T8 row selection: labelled log rows and hard negatives whose text is not in the base set.

    Equal (text, label) pairs are kept once; a left anti join on the text hash removes known rows. A text that is a hard
    negative is known to be normal, so what the log calls it is dropped.
    """
    # de-duplicate every side first (map-side partial aggregation), so a payload repeated in a third of all rows is one
    # row before the joins shuffle
    cand = new_rows.select(text, label).distinct().withColumn("_h", F.md5(F.col(text)))
    if hard_negatives is not None:
        hard = hard_negatives.select(text).distinct().select(text, F.lit("normal").alias(label), F.md5(F.col(text)).alias("_h"))
        cand = cand.join(hard.select("_h"), "_h", "left_anti").unionByName(hard)
    known = base.select(F.md5(F.col(text)).alias("_h")).distinct()
    return cand.join(known, "_h", "left_anti").select(text, label)


def retrain_from_logs(spark: SparkSession, base: DataFrame, new_rows: DataFrame,
                      hard_negatives: DataFrame | None = None, cfg: TrainConfig | None = None):
    """Append the selected rows to the base samples and rerun T3. Ids are strings in namespaces of their
    own (``base:<id>``, ``log:<md5>``), so new rows never meet base ids."""
    from reqsight.functions.rules import label_id
    add = retrain_rows(base, new_rows, hard_negatives)
    add = add.select(F.concat(F.lit("log:"), F.md5(F.concat_ws("\x1f", "label_str", "text"))).alias("id"), "text", "label_str",
                     label_id("label_str").alias("label"))
    old = base.select(F.concat(F.lit("base:"), F.col("id").cast("string")).alias("id"), "text", "label_str", "label")
    return train_and_evaluate(spark, old.unionByName(add), cfg)


def make_onnx_predict_fn(model_file: str, output: str = "logits"):
    """T6 helper for ``predict_batch_udf``: one onnxruntime session per Python worker.

    Returns the logits and, per row, the batch's inference time divided by its rows
    (the per-payload latency the reference prints; summarised by A9 ``latency_summary``).
    """
    def make():
        import time

        import numpy as np
        import onnxruntime as ort
        sess = ort.InferenceSession(model_file, providers=["CPUExecutionProvider"])

        def predict(ids, mask):
            t0 = time.perf_counter()
            try:
                out = sess.run([output], {"input_ids": ids.astype(np.int64),
                                          "attention_mask": mask.astype(np.int64)})[0].astype(np.float64)
            except Exception:
                out = np.full((ids.shape[0], NUM_CLASSES), np.nan)
            per_row = (time.perf_counter() - t0) / max(ids.shape[0], 1)
            return {"logits": out, "elapsed": np.full(ids.shape[0], per_row)}
        return predict
    return make


def score_external(df: DataFrame, model_file: str, ids: str = "ids", mask: str = "mask",
                   batch_size: int = 256) -> DataFrame:
    """Score ``ids``/``mask`` (ARRAY<INT>[128]) with a user-supplied ONNX file over Arrow batches.

    Adds ``logits, probs, pred, type, confidence`` and ``elapsed`` (seconds per row).
    A failed batch yields NaN (or NULL) logits, which become type ``error`` (fail-closed: the
    verdict of an ``error`` row is ATTACK unless ``verdict(..., on_error="ERROR")``).
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
    n = 128
    rtype = StructType([StructField("logits", ArrayType(DoubleType())), StructField("elapsed", DoubleType())])
    udf = predict_batch_udf(make_onnx_predict_fn(model_file), return_type=rtype,
                            batch_size=batch_size, input_tensor_shapes=[[n], [n]])
    out = df.withColumn("_o", udf(F.col(ids), F.col(mask)))
    out = out.withColumn("logits", F.col("_o.logits")).withColumn("elapsed", F.col("_o.elapsed")).drop("_o")
    bad = F.col("logits").isNull() | F.exists("logits", lambda x: x.isNull() | F.isnan(x))
    return (out.withColumn("probs", F.when(~bad, softmax("logits")))
            .withColumn("pred", F.when(~bad, argmax("logits")))
            .withColumn("type", F.when(bad, F.lit("error")).otherwise(label_name("pred")))
            .withColumn("confidence", F.element_at("probs", F.col("pred") + 1)))
