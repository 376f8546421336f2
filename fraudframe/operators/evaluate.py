"""Scored-table evaluation: confusion metrics, rank-sum ROC AUC, summaries.

All metrics are single aggregates over the scored table; the AUC reads the
average ranks of the scores off ``order_statistics`` (no sort into one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as X
from .ranks import order_statistics


def classification_metrics(df: DataFrame, label: str = "is_fraud",
                           prediction: str = "predicted_fraud") -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class; 0 on zero division."""
    y, p = F.col(label), F.col(prediction)
    c = df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
               F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"),
               F.count(F.lit(1)).alias("n"))
    prec = X.safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = X.safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = X.safe_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.select("tp", "fp", "fn", "tn",
                    X.safe_ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def roc_auc(df: DataFrame, label: str = "is_fraud", score: str = "fraud_probability", path: str = "auto") -> DataFrame:
    """Area under the ROC curve by the rank-sum (Mann-Whitney) formula.

    Tied scores get their average rank.  0.5 when one class is absent (the
    reference's fallback).
    """
    pos = F.when(F.col(label) == 1, 1).otherwise(0)
    stats = order_statistics(df.where(F.col(label).isNotNull()), score, weight=pos, path=path)
    t = stats.table
    avg_rank = F.col("rows_below") + (F.col("cnt") + 1) / 2.0
    a = t.agg(F.sum(F.col("wsum") * avg_rank).alias("r1"), F.sum("wsum").alias("n1"),
              F.sum("cnt").alias("n"))
    n1 = F.col("n1").cast("double")
    n0 = (F.col("n") - F.col("n1")).cast("double")
    auc = F.try_divide(F.col("r1") - n1 * (n1 + 1) / 2.0, n1 * n0)
    return a.select(F.coalesce(F.when((n1 > 0) & (n0 > 0), auc), F.lit(0.5)).alias("auc"))


def prediction_summary(df: DataFrame, threshold: float = S.HIGH_RISK_API,
                       prediction: str = "predicted_fraud", prob: str = "fraud_probability",
                       shown: int = S.HIGH_RISK_ROWS) -> DataFrame:
    """Rows, predicted fraud, rows above the threshold and how many of them are listed."""
    a = df.agg(F.count(F.lit(1)).alias("total_transactions"),
               F.coalesce(F.sum(F.col(prediction).cast("long")), F.lit(0)).alias("predicted_fraud"),
               F.count_if(F.col(prob) > threshold).alias("high_risk_count"))
    return a.withColumn("high_risk_shown", F.least(F.col("high_risk_count"), F.lit(shown)))


def prediction_correct(df: DataFrame, label: str = "is_fraud",
                       prediction: str = "predicted_fraud") -> DataFrame:
    """Scored rows with the correctness flag."""
    return df.withColumn("prediction_correct", F.col(label) == F.col(prediction))


def pseudo_probability(prediction: Column) -> Column:
    """0.8 / 0.2 stand-in for models that give no probabilities."""
    return F.when(prediction == 1, S.PSEUDO_PROBABILITY_POSITIVE).otherwise(
        S.PSEUDO_PROBABILITY_NEGATIVE)


def amount_vs_probability(df: DataFrame, prob: str | None = "fraud_probability") -> DataFrame:
    """Scatter dataset: amount, probability (the label when no score), colour, hover text."""
    p = F.col(prob) if prob and prob in df.columns else F.col("is_fraud").cast("double")
    fraud = F.col("is_fraud") == 1
    hover = F.format_string("Amount: $%.2f<br>Fraud: %s", F.col("amount"),
                            F.when(fraud, "Yes").otherwise("No"))
    return df.select("amount", p.alias("probability"),
                     F.when(fraud, "red").otherwise("green").alias("color"), hover.alias("hover_text"))
