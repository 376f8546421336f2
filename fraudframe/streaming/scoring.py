"""Structured Streaming scoring of new transactions with a saved model.

An addition to the batch engine (the reference has no streaming): new
transaction files are read with ``readStream``, given the row-local features
(amount coercion, label, time parts and flags, log amount), joined to a
*snapshot* of the dataset-relative features fitted on the training table
(category codes and frequencies, the p95 threshold) with stream-static
broadcast joins, aligned to the model's features and scored.  The snapshot is
written as parquet next to the model, so a restarted query reuses it.
A model that uses a feature of the whole table (average-rank percentile) is refused: fit the
streaming model on the processed table without it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import scalar as X
from ..operators import features as FE
from ..plans import ml

WHOLE_TABLE_FEATURES = {"amount_percentile"}


def fit_snapshot(processed: DataFrame, path: str, timestamp_format: str | None = None) -> str:
    """Write the lookup tables and thresholds of a processed training table.

    ``timestamp_format``: the form that was found in its times, if they were text (``FeatureFacts``).
    """
    form = processed.sparkSession.createDataFrame([(timestamp_format,)], "form string")
    form.coalesce(1).write.mode("overwrite").parquet(f"{path}/_time")
    for c in S.CATEGORICAL_FIELDS:
        if c in processed.columns:
            (processed.where(F.col(c).isNotNull())
             .groupBy(F.col(c).alias("value"))
             .agg(F.first(f"{c}_encoded").alias("code"), F.first(f"{c}_frequency").alias("freq"))
             .write.mode("overwrite").parquet(f"{path}/{c}"))
    thr = processed.agg(F.min(F.when(F.col("is_high_amount") == 1, F.col("amount"))).alias("t"),
                        F.max(F.when(F.col("is_high_amount") == 0, F.col("amount"))).alias("u"))
    thr.write.mode("overwrite").parquet(f"{path}/_threshold")
    return path


def stream_features(stream: DataFrame, mapping: dict, snapshot: str, label_mode: str = "map") -> DataFrame:
    """Row-local features plus snapshot lookups for a streaming (or batch) table."""
    spark = stream.sparkSession
    budget = FE.BROADCAST_BUDGET
    df = FE.rename_mapped(stream, mapping)
    df = FE.filter_amount(df)
    if "fraud_label" in df.columns:
        df = FE.standardize_label(df, label_mode).drop("fraud_label")
    if "timestamp" in df.columns:
        form = spark.read.parquet(f"{snapshot}/_time").first()["form"]
        df = FE.time_features(df, False, form)
    for c in S.CATEGORICAL_FIELDS:
        if c in df.columns:
            lk = spark.read.parquet(f"{snapshot}/{c}")
            # The row count comes from parquet footers; broadcast only within the plan's budget.
            cost = FE.lookup_bytes(lk.count(), 64.0)
            if cost <= budget:
                budget -= cost
                lk = F.broadcast(lk)
            df = (df.join(lk, df[c] == lk["value"], "left").drop("value")
                  .withColumns({f"{c}_encoded": F.coalesce(F.col("code"), F.lit(-1)).cast("int"),
                                f"{c}_frequency": F.col("freq")}).drop("code", "freq"))
    thr = spark.read.parquet(f"{snapshot}/_threshold")
    df = df.join(F.broadcast(thr), how="cross")  # one-row side
    df = df.withColumns({
        "amount_log": F.log1p("amount"),
        "amount_rounded": X.is_whole(F.col("amount")),
        # above every training amount flagged low -> high (the p95 cut lies between u and t)
        "is_high_amount": F.coalesce(F.col("amount") > F.col("u"), F.lit(False)).cast("int"),
    }).drop("t", "u")
    df = FE.hour_flags(df)
    return FE.rarity_flags(df)


def score_stream(spark: SparkSession, source: str, schema: T.StructType | str, model_path: str,
                 mapping: dict, snapshot: str, fmt: str = "parquet", label_mode: str = "map") -> DataFrame:
    """Streaming DataFrame of scored transactions (start it with ``writeStream``)."""
    model = ml.load_model(model_path, spark)
    whole = sorted(WHOLE_TABLE_FEATURES.intersection(model.spec.columns))
    if whole:
        raise ValueError(f"the model uses features a stream does not have: {', '.join(whole)}; train it without them")
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    return ml.score(model, stream_features(stream, mapping, snapshot, label_mode))
