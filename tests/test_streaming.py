"""Streaming scoring with a saved model and a fitted feature snapshot."""

import pytest
from pyspark.sql import functions as F

from fraudframe.plans import ml
from fraudframe.plans.catalog import processed
from fraudframe.session import scratch_path
from fraudframe.sources.tables import FIXTURE_MAPPINGS, fixture
from fraudframe.streaming import scoring

from .conftest import SF_SMALL


def test_stream_refuses_whole_table_features(spark):
    model, _ = ml.train_model(processed(spark, SF_SMALL, "fx1"), "logistic_regression", cross_validation=False)
    path = ml.save_model(model, scratch_path(spark, "model"))
    with pytest.raises(ValueError, match="amount_percentile"):
        scoring.score_stream(spark, "unused", "a int", path, FIXTURE_MAPPINGS["fx1"], "unused")


def test_stream_scores_every_row(spark):
    train = processed(spark, SF_SMALL, "fx1")
    model, _ = ml.train_model(train.drop("amount_percentile"), "logistic_regression", cross_validation=False)
    model_path = ml.save_model(model, scratch_path(spark, "model"))
    snap = scoring.fit_snapshot(train, scratch_path(spark, "snapshot"))
    raw = fixture(spark, SF_SMALL, "fx1")
    src = scratch_path(spark, "incoming")
    raw.repartition(3).write.parquet(src)
    scored = scoring.score_stream(spark, src, raw.schema, model_path,
                                  FIXTURE_MAPPINGS["fx1"], snap)
    q = scored.writeStream.format("memory").queryName("scored_stream").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    out = spark.sql("select * from scored_stream")
    assert out.count() == train.count()
    # batch features through the snapshot agree with the batch table on codes
    batch = scoring.stream_features(raw, FIXTURE_MAPPINGS["fx1"], snap).select(
        "transaction_id", "location_encoded", "is_high_amount")
    ref = train.select("transaction_id", F.col("location_encoded").alias("e"),
                       F.col("is_high_amount").alias("h"))
    j = batch.join(ref, "transaction_id")
    assert j.count() == train.count()
    assert j.where("location_encoded != e or is_high_amount != h").count() == 0
    acc = out.where("prediction_correct").count() / out.count()
    legit = out.where('is_fraud = 0').count() / out.count()
    assert acc > legit  # better than calling every row legitimate
