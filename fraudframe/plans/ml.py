"""Model training, evaluation and scoring as Spark ML jobs.

A model is one :class:`FraudModel`: the feature list, one code table per text feature (value ->
place in sorted order, unseen -> number of values) and a fitted ``PipelineModel``
  [logistic / svm: population-std standardisation, a fitted SQLTransformer] ->
  [svm: random Fourier features (SQLTransformer)] -> VectorAssembler -> estimator
  (+ calibration of the svm's margin); boosting ends in the trees of a :class:`Booster` instead.
It saves all of that under one path and scores any table by itself: missing features are 0 (text:
'nan'), missing values too.

Splits and folds are exact per class: rows are ordered by the md5 of seed and a unique key, and
cut at the order statistic each class needs, found by radix selection (no sort of the keys).  Class weights are a two-row aggregate turned into a
``weightCol`` expression.
"""

from __future__ import annotations

import json
import math
import random
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..operators import detect, evaluate
from ..operators.features import BROADCAST_BUDGET, lookup_bytes
from ..operators.ranks import dense_codes, order_statistics
from ..operators.select import hex_key, select_ranks
from ..session import checkpoint_dir, materialize, ship_package
from .boosting import Booster, fit_booster
from .newton import fit_logistic

ALGORITHMS = ["random_forest", "xgboost", "logistic_regression", "svm"]
#: Penalty strength of the logistic regression and the svm: sum(w * loss) * C + |b|^2 / 2.
PENALTY_C = 1.0
#: The RBF svm is a linear svm on random Fourier features: their number, and its iterations.
RFF_COMPONENTS = 100
SVM_ITERATIONS = 30
#: Most rows of a part of the training table: a forest keeps some 2 KB a row (100 sample weights, a place in each of 100 trees).
PART_ROWS = 200_000
#: Share of the training rows whose margins calibrate the svm (its margin is fitted without them).
CALIBRATION_SHARE = 0.2


@dataclass
class FeatureSpec:
    numeric: list[str]
    text: list[str]
    dropped: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return self.numeric + self.text


@dataclass
class FraudModel:
    spec: FeatureSpec
    pipeline: PipelineModel
    codes: dict[str, DataFrame]   # text feature -> (value, code)
    sizes: dict[str, int]         # text feature -> number of known values
    weights: list[float] | None = None  # of a logistic regression: intercept and coefficients
    gradient: float | None = None       # of its objective where the fit ended
    booster: Booster | None = None      # boosted trees take the place of the pipeline's estimator

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with label (where known), coded features, probability and prediction."""
        out = self.pipeline.transform(encode(prepare(df, self.spec), self.codes, self.sizes))
        if self.booster:
            ship_package(df.sparkSession)
            out = out.withColumn("probability", self.booster.probability(model_inputs(self.spec)))
            out = out.withColumn("prediction", (vector_to_array("probability")[1] > 0.5).cast("double"))
        return out


def feature_spec(df: DataFrame, keep_transaction_id: bool = False) -> FeatureSpec:
    """Feature columns: everything but the excluded canonical fields.

    ``transaction_id`` is excluded too unless ``keep_transaction_id`` (on
    generated data its text encodes the label).  Numbers and booleans are numeric features, all
    other atomic types text features; nested columns are listed in ``dropped``.
    """
    excluded = set(S.MODEL_EXCLUDED_COLUMNS)
    if not keep_transaction_id:
        excluded.add("transaction_id")
    spec = FeatureSpec([], [], [])
    for f in df.schema.fields:
        if f.name in excluded:
            continue
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            spec.numeric.append(f.name)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            spec.dropped.append(f.name)
        else:
            spec.text.append(f.name)
    return spec


def prepare(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Label as double, numeric features as doubles with missing -> 0, text with missing -> 'nan'.

    A feature column that is missing altogether is filled the same way.
    """
    def source(c: str, kind: str) -> Column:
        return (F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(kind)
    cols = {c: F.coalesce(source(c, "double"), F.lit(0.0)) for c in spec.numeric}
    cols.update({c: F.coalesce(source(c, "string"), F.lit("nan")) for c in spec.text})
    out = df.withColumns(cols) if cols else df
    if "is_fraud" in df.columns:
        out = out.withColumn("label", F.col("is_fraud").cast("double"))
    return out


def fit_codes(data: DataFrame, text: list[str]) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Sorted-order code table per text feature, however many values it has."""
    codes, sizes = {}, {}
    for c in text:
        table = dense_codes(order_statistics(data.select(F.col(f"`{c}`").alias("value")), "value")).select("value", "code")
        codes[c] = materialize(table, "text-codes")
        sizes[c] = codes[c].count()
    return codes, sizes


def encode(data: DataFrame, codes: dict[str, DataFrame], sizes: dict[str, int]) -> DataFrame:
    """``_idx_{c}`` per text feature: its code, or the number of known values if unseen."""
    left = BROADCAST_BUDGET
    for c, table in codes.items():
        cost = lookup_bytes(sizes[c], 64.0)
        if cost <= left:
            left -= cost
            table = F.broadcast(table)
        table = table.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        data = (data.join(table, F.col(f"`{c}`") == F.col("_value"), "left")
                .withColumn(f"_idx_{c}", F.coalesce(F.col("_code"), F.lit(sizes[c])).cast("double")).drop("_value", "_code"))
    return data


def model_inputs(spec: FeatureSpec) -> list[str]:
    return spec.numeric + [f"_idx_{c}" for c in spec.text]


# --- splits -----------------------------------------------------------------------------

def split_hash(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(f"`{key}`").cast("string")))


def _cuts(df: DataFrame, place: Column, shares: list[float], label: str) -> dict:
    """Per class, the largest hash of the first round(n * share) rows in hash order."""
    def last(n: int, share: float) -> int:
        return math.floor(n * share + 0.5) - 1
    found = select_ranks(df, place, hex_key(place), lambda _, n: [last(n, s) for s in shares], F.col(label))
    return {g: [at.get(last(n, s)) for s in shares] for g, (n, at) in found.items()}


def _at_most(place: Column, cuts: dict, i: int, label: str) -> Column:
    inside = F.lit(False)
    for value, c in cuts.items():
        if c[i] is not None:
            inside = inside | (F.col(label).eqNullSafe(F.lit(value)) & (place <= F.lit(c[i])))
    return inside


def stratified_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = "transaction_id",
                     label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(train, test): of every class exactly round(n * test_size) rows are in test.

    ``key`` must be unique; the order is the md5 of seed and key, so it can be repeated anywhere.
    """
    place = split_hash(seed, key)
    test = _at_most(place, _cuts(df, place, [test_size], label), 0, label)
    return df.where(~test), df.where(test)


def fold_column(df: DataFrame, k: int = 5, seed: int = 42, key: str = "transaction_id", label: str = "label") -> Column:
    """Fold 0..k-1 of every row, each holding the same share of every class."""
    place = split_hash(seed + 1, key)
    cuts = _cuts(df, place, [f / k for f in range(1, k)], label)
    fold = F.lit(k - 1)
    for i in reversed(range(k - 1)):
        fold = F.when(_at_most(place, cuts, i, label), F.lit(i)).otherwise(fold)
    return fold


def keyed(data: DataFrame, key: str = "transaction_id") -> tuple[DataFrame, str]:
    """``data`` with a unique key: the given column, or row numbers fixed by writing the table."""
    if key in data.columns:
        return data, key
    return materialize(data.withColumn("_row", F.monotonically_increasing_id()), "keyed"), "_row"


# --- fitting ----------------------------------------------------------------------------

def balanced_weights(train: DataFrame, label: str = "label") -> dict[float, float]:
    """n / (k * n_c) per class (a two-row aggregate)."""
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    n, k = sum(counts.values()), len(counts)
    return {c: n / (k * v) for c, v in counts.items()}


def weight_column(weights: dict[float, float], label: str = "label"):
    expr = F.lit(1.0)
    for c, w in weights.items():
        expr = F.when(F.col(label) == c, F.lit(w)).otherwise(expr)
    return expr


def kept_in_parts(data: DataFrame) -> DataFrame:
    """``data`` persisted, dealt anew where a part has more than ``PART_ROWS`` rows."""
    held = data.persist(StorageLevel.MEMORY_AND_DISK)
    r = held.groupBy(F.spark_partition_id()).count().agg(F.max("count").alias("most"), F.sum("count").alias("n"), F.count(F.lit(1)).alias("parts")).first()
    if (r["most"] or 0) <= PART_ROWS:
        return held
    dealt = held.repartition(max(r["parts"], -(-r["n"] // PART_ROWS))).persist(StorageLevel.MEMORY_AND_DISK)
    dealt.count()
    held.unpersist()
    return dealt


def fit_scaler(train: DataFrame, cols: list[str]) -> SQLTransformer:
    """(x - mean) / population std fitted on ``train``; constant columns scale by 1."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(F.col(f"`{c}`")).alias(f"m{i}"), F.stddev_pop(F.col(f"`{c}`")).alias(f"s{i}")]
    r = train.agg(*aggs).first()
    parts = []
    for i, c in enumerate(cols):
        m = r[f"m{i}"] or 0.0
        s = r[f"s{i}"] or 0.0
        s = s if s > 0 else 1.0
        parts.append(f"(`{c}` - {m!r}) / {s!r} AS `_z_{c}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def _rff_sql(inputs: list[str], seed: int, d: int = RFF_COMPONENTS) -> tuple[SQLTransformer, list[str]]:
    """Random Fourier features for an RBF kernel with gamma = 1 / n_features
    (standardised inputs have unit variance, matching gamma='scale')."""
    rng = random.Random(seed)
    gamma = 1.0 / max(len(inputs), 1)
    scale = math.sqrt(2.0 / d)
    parts, names = [], []
    for j in range(d):
        terms = " + ".join(f"`{c}` * {rng.gauss(0.0, math.sqrt(2 * gamma))!r}" for c in inputs)
        b = rng.uniform(0, 2 * math.pi)
        names.append(f"_rff{j}")
        parts.append(f"{scale!r} * cos({terms} + {b!r}) AS _rff{j}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__"), names


def feature_stages(coded: DataFrame, spec: FeatureSpec, algorithm: str, seed: int) -> list:
    """Everything up to the assembled vector."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"Unsupported algorithm: {algorithm}")
    stages, inputs = [], model_inputs(spec)
    if algorithm in ("logistic_regression", "svm"):
        stages.append(fit_scaler(coded, inputs))
        inputs = [f"_z_{c}" for c in inputs]
    if algorithm == "svm":
        rff, inputs = _rff_sql(inputs, seed)
        stages.append(rff)
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")]


def penalty(total_weight: float, c: float = PENALTY_C) -> float:
    """Spark divides the loss by the total row weight; C * sum(w * loss) + |b|^2 / 2 does not."""
    return 1.0 / (c * max(total_weight, 1e-12))


def _estimator(algorithm: str, seed: int, total_weight: float):
    if algorithm == "random_forest":
        return RandomForestClassifier(numTrees=100, maxDepth=10, featureSubsetStrategy="sqrt", seed=seed, labelCol="label",
                                      weightCol="weight", cacheNodeIds=True, checkpointInterval=10)
    return LinearSVC(maxIter=SVM_ITERATIONS, tol=1e-4, standardization=False, labelCol="label", weightCol="weight",
                     regParam=penalty(total_weight), rawPredictionCol="_svm_raw", predictionCol="_svm_pred")


def _row_weight(algorithm: str, weights: dict) -> Column:
    if algorithm == "xgboost":
        # Boosting takes one positive weight w1/w0 and leaves negatives at 1.
        pos = weights.get(1.0, 1.0) / weights.get(0.0, 1.0) if len(weights) > 1 else 1.0
        return F.when(F.col("label") == 1.0, F.lit(pos)).otherwise(1.0)
    return weight_column(weights)


def fit_model(train: DataFrame, spec: FeatureSpec, algorithm: str, seed: int = 42, key: str = "transaction_id") -> FraudModel:
    """Fit codes, feature stages and estimator on ``train`` (prepared rows with a unique ``key``)."""
    codes, sizes = fit_codes(train, spec.text)
    weights = balanced_weights(train)
    coded = encode(train, codes, sizes).withColumn("weight", _row_weight(algorithm, weights))
    feat = Pipeline(stages=feature_stages(coded, spec, algorithm, seed)).fit(coded)
    if algorithm == "xgboost":
        return FraudModel(spec, feat, codes, sizes, booster=fit_booster(coded, model_inputs(spec)))
    vec = feat.transform(coded).select(F.col(f"`{key}`").alias("_key"), "label", "features", "weight")
    if algorithm == "logistic_regression":
        fit = fit_logistic(vec, PENALTY_C)  # keeps the rows in a form of its own
        inputs = [f"_z_{c}" for c in model_inputs(spec)]
        return FraudModel(spec, PipelineModel(stages=feat.stages + fit.stages(inputs)), codes, sizes, fit.weights, fit.gradient)
    vec = vec.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = vec.agg(F.sum("weight")).first()[0] or 0.0
        stages = [_estimator(algorithm, seed, total)]
        if algorithm == "svm":
            # The margin of rows the svm has not seen, then a logistic curve over it.
            rest, held = stratified_split(vec, CALIBRATION_SHARE, seed + 2, key="_key")
            part = LinearSVC(**{k.name: v for k, v in stages[0].extractParamMap().items()})
            part.setRegParam(penalty(rest.agg(F.sum("weight")).first()[0] or 0.0))
            margin = VectorSlicer(inputCol="_svm_raw", outputCol="_svm_margin", indices=[1])
            curve = LogisticRegression(featuresCol="_svm_margin", labelCol="label", maxIter=100)
            fitted = curve.fit(margin.transform(part.fit(rest).transform(held)))
            pipe = PipelineModel(stages=feat.stages + [stages[0].fit(vec), margin, fitted])
        else:
            pipe = PipelineModel(stages=feat.stages + [stages[0].fit(vec)])
    finally:
        vec.unpersist()
    return FraudModel(spec, pipe, codes, sizes)


def penalised_gradient(model: FraudModel, train: DataFrame) -> float:
    """Largest partial derivative of sum(w * log-loss) + |b|^2 / (2 C), per unit of total weight.

    Near zero at the fitted coefficients of a logistic regression, whatever fitted them.
    """
    beta = model.weights[1:]
    rows = model.transform(train).withColumn("weight", weight_column(balanced_weights(train)))
    x, off = vector_to_array("features"), F.col("weight") * (vector_to_array("probability")[1] - F.col("label"))
    sums = rows.agg(F.sum(off).alias("g"), F.sum("weight").alias("w"), *[F.sum(off * x[i]).alias(f"g{i}") for i in range(len(beta))])
    r = sums.first()
    return max([abs(r["g"])] + [abs(r[f"g{i}"] + b / PENALTY_C) for i, b in enumerate(beta)]) / r["w"]


def probability_column(model_df: DataFrame) -> DataFrame:
    return model_df.withColumn("fraud_probability", vector_to_array(F.col("probability"))[1])


def evaluate_predictions(pred: DataFrame) -> dict:
    """Hold-out metrics; the scored rows are persisted for the three metric jobs."""
    scored = (probability_column(pred)
              .select(F.col("label").cast("int").alias("_y"), F.col("prediction").cast("int").alias("_p"),
                      "fraud_probability")
              .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        m = evaluate.classification_metrics(scored, "_y", "_p").first()
        auc = evaluate.roc_auc(scored, "_y", "fraud_probability").first()["auc"]
    finally:
        scored.unpersist()
    return {"accuracy": m["accuracy"], "precision": m["precision"], "recall": m["recall"],
            "f1": m["f1"], "auc": auc}


def train_model(df: DataFrame, algorithm: str = "random_forest", test_size: float = 0.2,
                random_state: int = 42, cross_validation: bool = True,
                keep_transaction_id: bool = False, cv_folds: int = 5, key: str = "transaction_id"):
    """(model, hold-out metrics and, optionally, k-fold F1) of an exact stratified split."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"Unsupported algorithm: {algorithm}")
    check = detect.validate_model_input(df, ["amount", "is_fraud"] if "amount" in df.columns else ["is_fraud"]).first()
    if not check["ok"]:
        raise ValueError(check["message"])
    checkpoint_dir(df.sparkSession)  # tree learners checkpoint long lineages there
    spec = feature_spec(df, keep_transaction_id)
    data, key = keyed(prepare(df, spec), key)
    # Iterative fitting re-reads its input many times: keep the prepared
    # feature columns (not the wide source rows) persisted for the duration.
    keep = list(dict.fromkeys([key, *spec.columns, "label"]))
    data = kept_in_parts(data.select(*[F.col(f"`{c}`") for c in keep]))
    try:
        train, test = stratified_split(data, test_size, random_state, key)
        model = fit_model(train, spec, algorithm, random_state, key)
        metrics = evaluate_predictions(model.transform(test))
        if algorithm == "logistic_regression":
            metrics["gradient"] = model.gradient
        if cross_validation:
            metrics.update(cross_validate(train, spec, algorithm, random_state, cv_folds, key))
    finally:
        data.unpersist()
    return model, metrics


#: Folds of a cross-validation that are fitted at the same time.
FOLDS_AT_ONCE = 5


def cross_validate(train: DataFrame, spec: FeatureSpec, algorithm: str, seed: int = 42,
                   k: int = 5, key: str = "transaction_id", at_once: int = FOLDS_AT_ONCE) -> dict:
    """k exact stratified folds: F1 per held-out fold; mean and population std.

    The folds are jobs of their own over one prepared table (cut once), submitted side by side: while one
    waits for the driver or its last task, the others use the cluster.  The scores are those of one after the other.
    """
    folded = train.withColumn("_fold", fold_column(train, k, seed, key)).persist(StorageLevel.MEMORY_AND_DISK)

    def one(f: int) -> float:
        model = fit_model(folded.where(F.col("_fold") != f).drop("_fold"), spec, algorithm, seed, key)
        return evaluate_predictions(model.transform(folded.where(F.col("_fold") == f).drop("_fold")))["f1"]
    try:
        folded.count()  # prepared once, before the folds meet it at the same time
        with ThreadPoolExecutor(max(1, min(k, at_once))) as pool:
            scores = list(pool.map(inheritable_thread_target(train.sparkSession)(one), range(k)))
    finally:
        folded.unpersist()
    mean = sum(scores) / k
    std = math.sqrt(sum((s - mean) ** 2 for s in scores) / k)
    return {"cv_f1_mean": mean, "cv_f1_std": std}


METRICS = ["accuracy", "precision", "recall", "f1", "auc", "cv_f1_mean", "cv_f1_std"]


def metrics_frame(spark, algorithm: str, metrics: dict) -> DataFrame:
    """One row; figures to three places, as the reports show them, and whether the optimum was reached."""
    row = [algorithm] + [round(float(metrics[k]), 3) if metrics.get(k) is not None else None for k in METRICS]
    row.append(metrics["gradient"] < 1e-4 if "gradient" in metrics else None)
    schema = "algorithm string, " + ", ".join(f"{k} double" for k in METRICS) + ", at_optimum boolean"
    return spark.createDataFrame([row], schema)


def align_features(df: DataFrame, feature_columns: list[str]) -> DataFrame:
    """Known features in training order; a missing one is added as 0."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(0.0).alias(c)
                       for c in feature_columns])


def score(model: FraudModel, df: DataFrame) -> DataFrame:
    """Scored rows: the input plus predicted_fraud, fraud_probability, prediction_correct."""
    out = probability_column(model.transform(df.select("*", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_input"))))
    out = out.withColumn("predicted_fraud", F.col("prediction").cast("int")).select(
        "_input.*", "predicted_fraud", "fraud_probability")
    if "is_fraud" in df.columns:
        out = evaluate.prediction_correct(out)
    return out


def save_model(model: FraudModel, path: str) -> str:
    """Everything a new session needs to score, as a new version under ``path``.

    A version is written into a folder of its own, and only then named by a manifest, the last file written;
    a job that ends in between leaves the versions before it as they were.
    """
    spark = SparkSession.active()
    version = f"{path}/versions/{uuid.uuid4().hex}"
    model.pipeline.write().overwrite().save(f"{version}/pipeline")
    for i, c in enumerate(model.spec.text):
        model.codes[c].write.mode("overwrite").parquet(f"{version}/codes/{i}")
    facts = {"spec": asdict(model.spec), "sizes": model.sizes, "weights": model.weights, "gradient": model.gradient,
             "booster": model.booster.to_dict() if model.booster else None}
    number = max((n for n, _ in manifests(path, spark)), default=0) + 1
    row = [(json.dumps({"version": version.rsplit("/", 1)[1], "facts": facts}),)]
    # A text file is renamed into place when its job commits: the manifest is there whole or not at all.
    spark.createDataFrame(row, "value string").coalesce(1).write.mode("error").text(f"{path}/manifests/{number:08d}")
    return path


def manifests(path: str, spark: SparkSession) -> list[tuple[int, str]]:
    """(number, folder) of the committed manifests of a model, through Spark's own file system layer."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    found = [s.getPath() for s in system.listStatus(folder)]
    done = [p for p in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted((int(p.getName()), f"{path}/manifests/{p.getName()}") for p in done)


def load_model(path: str, spark: SparkSession | None = None, number: int | None = None) -> FraudModel:
    """The last committed version (or the ``number``-th) of the model under ``path``."""
    spark = spark or SparkSession.active()
    known = dict(manifests(path, spark))
    if not known:
        raise ValueError(f"no committed model under {path}")
    manifest = json.loads(spark.read.text(known[number if number is not None else max(known)]).first()["value"])
    version, facts = f"{path}/versions/{manifest['version']}", manifest["facts"]
    spec = FeatureSpec(**facts["spec"])
    codes = {c: spark.read.parquet(f"{version}/codes/{i}") for i, c in enumerate(spec.text)}
    booster = Booster.from_dict(facts["booster"]) if facts["booster"] else None
    return FraudModel(spec, PipelineModel.load(f"{version}/pipeline"), codes, facts["sizes"], facts["weights"], facts["gradient"], booster)
