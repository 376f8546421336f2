"""Fraud profiling over a processed table: counts, rates, per-class amount
statistics, breakdowns by hour / day / category, top-k lists and filters.

Every aggregate is a partial+final ``groupBy``/``agg`` (map-side combine, so a
hot key costs one row per task); top-k lists are ``orderBy(...).limit(k)``,
which Spark plans as a per-partition TakeOrdered; nothing sorts the whole
table into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as X
from ..sources.ordering import POSITION
from .ranks import quantile_table


def fraud_flag() -> Column:
    return F.col("is_fraud") == 1


def legit_flag() -> Column:
    return F.col("is_fraud") == 0


def fraud_rows(df: DataFrame) -> DataFrame:
    return df.where(fraud_flag())


def legit_rows(df: DataFrame) -> DataFrame:
    return df.where(legit_flag())


def headline_metrics(df: DataFrame) -> DataFrame:
    """Total, fraud count, fraud rate in % (2 dp), mean fraud amount (0 if none, 2 dp)."""
    a = df.agg(F.count(F.lit(1)).alias("t"), F.count_if(fraud_flag()).alias("f"),
               F.avg(F.when(fraud_flag(), F.col("amount"))).alias("m"))
    return a.select(
        F.col("t").alias("total_transactions"),
        F.col("f").alias("fraud_transactions"),
        # Halves go to the even digit, as the reports round.
        F.bround(X.safe_ratio(F.col("f") * 100.0, F.col("t")), 2).alias("fraud_rate"),
        F.bround(F.coalesce(F.col("m"), F.lit(0.0)), 2).alias("avg_fraud_amount"))


def fraud_counts(df: DataFrame) -> DataFrame:
    """Fraud and legitimate counts and the fraud rate as a fraction (0 if empty)."""
    a = df.agg(F.count_if(fraud_flag()).alias("fraud_count"), F.count_if(legit_flag()).alias("legitimate_count"),
               F.count(F.lit(1)).alias("_n"))
    return a.select("fraud_count", "legitimate_count",
                    X.safe_ratio(F.col("fraud_count"), F.col("_n")).alias("fraud_rate"))


def _classes(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(2).select(F.col("id").cast("int").alias("is_fraud"))


def amount_stats_by_class(df: DataFrame, path: str = "auto") -> DataFrame:
    """Per class: mean, median, sample std, total; every figure 0 for an empty class.

    The median is exact (linear interpolation): of counted values if they are few, else by radix selection.
    """
    basic = df.groupBy("is_fraud").agg(
        F.count(F.lit(1)).alias("n"), F.avg("amount").alias("mean"),
        F.stddev_samp("amount").alias("std"), F.sum("amount").alias("total"))
    med = quantile_table(df, "amount", [0.5], ["median"], ["is_fraud"], path)
    # Both per-class aggregates hold at most one row per class: broadcast.
    out = (_classes(df).join(F.broadcast(basic), "is_fraud", "left")
           .join(F.broadcast(med), "is_fraud", "left"))
    zero = F.lit(0.0)
    present = F.coalesce(F.col("n"), F.lit(0)) > 0
    return out.select(
        "is_fraud",
        F.coalesce(F.col("n"), F.lit(0)).alias("count"),
        F.when(present, F.col("mean")).otherwise(zero).alias("mean"),
        F.when(present, F.col("median")).otherwise(zero).alias("median"),
        F.when(present, F.col("std")).otherwise(zero).alias("std"),
        # Sums of doubles depend on addition order in their last digits; the
        # total is reported in cents.
        F.round(F.when(present, F.col("total")).otherwise(zero), 2).alias("total"))


def total_fraud_amount(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.when(fraud_flag(), F.col("amount"))), F.lit(0.0))
                  .alias("total_fraud_amount"))


def fraud_by_hour(df: DataFrame) -> DataFrame:
    """Fraud count per hour of day (missing hours excluded), ordered by hour."""
    return (df.where(fraud_flag() & F.col("hour").isNotNull()).groupBy("hour")
            .agg(F.count(F.lit(1)).alias("fraud_count")).orderBy("hour"))


def top_fraud_category(df: DataFrame, column: str, n: int = S.TOP_CATEGORIES) -> DataFrame:
    """The n most frequent values of ``column`` among fraud rows.

    Ties stand in order of first appearance if the rows know their place in the files
    (:func:`fraudframe.sources.ordering.with_position`), else in the order of the values.
    """
    fraud = df.where(fraud_flag() & F.col(column).isNotNull())
    if POSITION in df.columns:
        counts = fraud.groupBy(column).agg(F.count(F.lit(1)).alias("fraud_count"), F.min(POSITION).alias("_first"))
        return counts.orderBy(F.col("fraud_count").desc(), F.col("_first").asc()).limit(n).drop("_first")
    return (fraud.groupBy(column).agg(F.count(F.lit(1)).alias("fraud_count"))
            .orderBy(F.col("fraud_count").desc(), F.col(column).asc()).limit(n))


def fraud_distribution(df: DataFrame) -> DataFrame:
    """Class counts for the pie; an absent class counts 0."""
    counts = df.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("n"))
    return (_classes(df).join(F.broadcast(counts), "is_fraud", "left").select(
        "is_fraud",
        F.when(F.col("is_fraud") == 1, "Fraud").otherwise("Legitimate").alias("label"),
        F.coalesce(F.col("n"), F.lit(0)).alias("count")))


def _day(df: DataFrame) -> Column:
    return F.to_date(F.col("timestamp"))


def daily_timeline(df: DataFrame) -> DataFrame:
    """Per day: total, fraud count and fraud rate in %; one aggregate, no join."""
    a = (df.where(F.col("timestamp").isNotNull()).groupBy(_day(df).alias("date"))
         .agg(F.count(F.lit(1)).alias("total_count"), F.count_if(fraud_flag()).alias("fraud_count")))
    return a.select(F.col("date").cast("string").alias("date"), "total_count", "fraud_count",
                    (F.col("fraud_count") * 100.0 / F.col("total_count")).alias("fraud_rate"))


def daily_timeline_join(df: DataFrame) -> DataFrame:
    """Same result the reference's way: daily fraud counts right-joined to daily totals.

    Both sides are one row per day (bounded by the date range), so the join
    is between two small aggregates.
    """
    days = df.where(F.col("timestamp").isNotNull()).withColumn("date", _day(df))
    fraud = days.where(fraud_flag()).groupBy("date").agg(F.count(F.lit(1)).alias("fraud_count"))
    total = days.groupBy("date").agg(F.count(F.lit(1)).alias("total_count"))
    j = fraud.join(total, "date", "right").fillna(0, subset=["fraud_count"])
    return j.select(F.col("date").cast("string").alias("date"), "total_count", "fraud_count",
                    (F.col("fraud_count") * 100.0 / F.col("total_count")).alias("fraud_rate"))


def amount_histogram(df: DataFrame, bins: int = S.HISTOGRAM_BINS) -> DataFrame:
    """Per class, ``bins`` equal-width bins between the class min and max.

    Two passes: per-class min/max (two rows, broadcast), then bucket counts.
    """
    rng = df.groupBy("is_fraud").agg(F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    j = df.select("is_fraud", "amount").join(F.broadcast(rng), "is_fraud")
    bucket = F.when(F.col("hi") > F.col("lo"),
                    F.least(F.lit(bins - 1),
                            F.floor((F.col("amount") - F.col("lo")) / width).cast("int"))
                    ).otherwise(F.lit(0))
    counts = (j.withColumn("bin", bucket.cast("int"))
              .groupBy("is_fraud", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("count")))
    return counts.select(
        "is_fraud", "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        F.when(F.col("hi") > F.col("lo"), F.col("lo") + (F.col("bin") + 1) * width)
        .otherwise(F.col("hi")).alias("bin_end"),
        "count")


def fraud_head(df: DataFrame, key: str, n: int = S.HEAD_ROWS) -> DataFrame:
    """First n fraud rows in input order (``key`` carries the order; ``_position`` is file order)."""
    return df.where(fraud_flag()).orderBy(F.col(key).asc()).limit(n)


def fraud_by_amount(df: DataFrame, key: str) -> DataFrame:
    """All fraud rows, largest amount first (``key`` breaks ties)."""
    return df.where(fraud_flag()).orderBy(F.col("amount").desc(), F.col(key).asc())


def fraud_amount_range(df: DataFrame, lo: float = 0.0, hi: float | None = None) -> DataFrame:
    """Fraud rows with lo <= amount <= hi; hi defaults to the largest fraud amount."""
    fr = df.where(fraud_flag())
    if hi is None:
        top = fr.agg(F.max("amount").alias("_hi"))
        return (fr.crossJoin(F.broadcast(top))   # one-row side
                .where(F.col("amount").between(F.lit(lo), F.col("_hi"))).drop("_hi"))
    return fr.where(F.col("amount").between(lo, hi))


def fraud_amount_max(df: DataFrame) -> DataFrame:
    """The largest fraud amount, the default upper bound of the range (0 without fraud rows)."""
    return df.where(fraud_flag()).agg(F.coalesce(F.max("amount"), F.lit(0.0)).alias("max_fraud_amount"))


def high_risk(df: DataFrame, threshold: float, order: str, key: str,
              n: int = S.HIGH_RISK_ROWS, prob: str = "fraud_probability") -> DataFrame:
    """Rows scored above ``threshold``: first n by input order (``order='input'``,
    the API) or by probability descending (``order='probability'``, the UI)."""
    hr = df.where(F.col(prob) > threshold)
    if order == "input":
        return hr.orderBy(F.col(key).asc()).limit(n)
    return hr.orderBy(F.col(prob).desc(), F.col(key).asc()).limit(n)


def class_weights(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Balanced weights n / (k * n_c) and the boosting positive weight w1 / w0."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    tot = counts.agg(F.sum("n_rows").alias("_n"), F.count(F.lit(1)).alias("_k"),
                     F.max(F.when(F.col(label) == 0, F.col("n_rows"))).alias("_n0"),
                     F.max(F.when(F.col(label) == 1, F.col("n_rows"))).alias("_n1"))
    w = counts.crossJoin(F.broadcast(tot))  # one-row side
    return w.select(
        F.col(label).alias(label), "n_rows",
        (F.col("_n") / (F.col("_k") * F.col("n_rows"))).alias("weight"),
        F.coalesce(F.try_divide(F.col("_n0").cast("double"), F.col("_n1")), F.lit(1.0))
        .alias("scale_pos_weight"))
