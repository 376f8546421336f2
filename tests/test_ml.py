"""Model jobs: weights, split, scaler, save/load, alignment."""

import pytest
from pyspark.sql import functions as F

from fraudframe.plans import ml
from fraudframe.plans.catalog import processed
from fraudframe.session import scratch_path

from .conftest import SF_SMALL


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0.0,)] * 9 + [(1.0,)] * 3, "label double")
    w = ml.balanced_weights(df)
    assert w[0.0] == pytest.approx(12 / (2 * 9)) and w[1.0] == pytest.approx(12 / (2 * 3))


def test_split_and_folds_are_exact_per_class(spark):
    # 700 equal fraud rows among 2,000: every class is cut at its exact share.
    df = spark.range(2000).select(F.col("id").alias("transaction_id"), (F.col("id") < 700).cast("double").alias("label"))
    tr, te = ml.stratified_split(df, 0.2, 42)
    assert tr.count() + te.count() == 2000 and tr.join(te, "transaction_id").count() == 0
    assert {r["label"]: r["count"] for r in te.groupBy("label").count().collect()} == {0.0: 260, 1.0: 140}
    folds = df.withColumn("f", ml.fold_column(df, 5, 42)).groupBy("f", "label").count().collect()
    assert sorted((r["f"], r["label"], r["count"]) for r in folds) == [(f, c, n) for f in range(5) for c, n in ((0.0, 260), (1.0, 140))]


def test_train_save_load_score(spark):
    df = processed(spark, SF_SMALL, "fx1")
    model, metrics = ml.train_model(df, "logistic_regression", cross_validation=False)
    assert metrics["auc"] >= 0.98 and metrics["f1"] >= 0.8
    # The optimum of sum(w * loss) + |b|^2 / 2, not of some other penalty.
    assert metrics["gradient"] < 1e-5
    path = ml.save_model(model, scratch_path(spark, "model"))
    a = ml.score(model, df).select("transaction_id", "fraud_probability")
    b = ml.score(ml.load_model(path, spark), df).select("transaction_id", "fraud_probability")
    assert a.exceptAll(b).count() == 0
    # A table without some features and without a label is scored too.
    bare = ml.score(ml.load_model(path, spark), df.select("transaction_id", "amount"))
    assert bare.columns == ["transaction_id", "amount", "predicted_fraud", "fraud_probability"] and bare.count() == df.count()


def test_svm_learns_and_its_penalty_follows_the_rows(spark):
    df = processed(spark, SF_SMALL, "fx1")
    model, metrics = ml.train_model(df, "svm", cross_validation=False)
    assert metrics["auc"] > 0.9
    svc = next(s for s in model.pipeline.stages if "LinearSVC" in type(s).__name__)
    n = round(0.8 * df.count())
    assert svc.getRegParam() == pytest.approx(1 / n, rel=0.02)


def test_text_feature_with_many_values_trains_and_scores(spark):
    n = 120_000
    df = spark.range(n).select(
        F.col("id").alias("transaction_id"), (F.col("id") % 97).cast("double").alias("amount"),
        F.concat(F.lit("note"), F.col("id").cast("string")).alias("note"), (F.col("id") % 97 > 80).cast("int").alias("is_fraud"))
    model, metrics = ml.train_model(df, "logistic_regression", cross_validation=False)
    assert model.spec.text == ["note"] and model.sizes["note"] == 96_000 and metrics["auc"] > 0.9
    assert ml.score(model, df.limit(10)).count() == 10


def test_one_class_is_refused(spark):
    df = spark.range(50).select("id", F.lit(1.0).alias("amount"), F.lit(0).alias("is_fraud"))
    with pytest.raises(ValueError, match="both fraud and legitimate"):
        ml.train_model(df, "random_forest")


def test_forest_learns_the_label(spark):
    df = processed(spark, SF_SMALL, "fx1")
    _, metrics = ml.train_model(df, "random_forest", cross_validation=False)
    assert metrics["auc"] > 0.95


def test_no_task_of_a_fit_reads_more_than_part_rows(spark, monkeypatch):
    df = spark.range(0, 4000, 1, 1).select(F.col("id").alias("transaction_id"), (F.col("id") % 7).cast("double").alias("amount"),
                                           (F.col("id") % 7 > 4).cast("int").alias("is_fraud"))
    monkeypatch.setattr(ml, "PART_ROWS", 500)
    seen, fit = [], ml.fit_model

    def watched(train, *more):
        seen.extend(r["count"] for r in train.groupBy(F.spark_partition_id()).count().collect())
        return fit(train, *more)
    monkeypatch.setattr(ml, "fit_model", watched)
    _, metrics = ml.train_model(df, "logistic_regression", cross_validation=False)
    assert sum(seen) == 3200 and max(seen) <= 500 and metrics["auc"] == 1.0


def test_align_adds_missing_as_zero(spark):
    df = spark.createDataFrame([(1.0, 2)], "a double, b int")
    out = ml.align_features(df, ["b", "c", "a"])
    assert out.columns == ["b", "c", "a"] and out.first()["c"] == 0.0


def test_feature_spec_excludes_ids_and_codes_unseen_text(spark):
    df = spark.createDataFrame(
        [(i, f"T{i}", ["a", "b"][i % 2], float(i), i % 2) for i in range(50)],
        "transaction_id long, note string, channel string, amount double, is_fraud int")
    spec = ml.feature_spec(df)
    assert "transaction_id" not in spec.columns and "is_fraud" not in spec.columns
    assert spec.text == ["note", "channel"] and not spec.dropped
    assert ml.feature_spec(df, keep_transaction_id=True).numeric[0] == "transaction_id"
    data = ml.prepare(df, spec)
    codes, sizes = ml.fit_codes(data.where("channel = 'a'"), ["channel"])
    got = {r["channel"]: r["_idx_channel"] for r in ml.encode(data, codes, sizes).collect()}
    assert got == {"a": 0.0, "b": 1.0} and sizes == {"channel": 1}
