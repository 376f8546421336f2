"""Data-quality checks on a raw table: column statistics, missing values,
duplicate rows, sign issues in amount columns, IQR outliers, column types.

Each check is one aggregate (all columns at once where it applies); exact
quartiles are counted or found by radix selection, not by a whole-column
percentile buffer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..session import materialize
from .features import BROADCAST_BUDGET, lookup_bytes
from .ranks import quantile_table


def _numeric(df: DataFrame, column: str):
    return X.to_number(F.col(f"`{column}`"), df.schema[column].dataType)


def basic_stats(df: DataFrame, column: str, path: str = "auto") -> DataFrame:
    """count, mean, median, std, min, max, q25, q75 after numeric coercion."""
    num = df.select(_numeric(df, column).alias("x")).where(F.col("x").isNotNull())
    moments = num.agg(F.count(F.lit(1)).alias("count"), F.avg("x").alias("mean"),
                      F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
                      F.max("x").alias("max"))
    q = quantile_table(num, "x", [0.5, 0.25, 0.75], ["median", "q25", "q75"], path=path)
    return (moments.crossJoin(q)  # both sides are one row
            .where(F.col("count") > 0)
            .select(F.lit(column).alias("column"), "count", "mean", "median", "std", "min", "max",
                    "q25", "q75"))


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, only columns with at least one."""
    cols = df.columns
    agg = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"))
                      for i, c in enumerate(cols)])
    return agg.select(F.inline(pairs)).where(F.col("missing_count") > 0)


def row_digest(df: DataFrame) -> list:
    """128 bits of a row as two longs; rows equal with nulls equal have equal digests."""
    parts = [x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return [F.xxhash64(F.lit(0), *parts).alias("_d0"), F.xxhash64(F.lit(1), *parts).alias("_d1")]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal (nulls equal) to an earlier row, over all columns.

    What is shuffled are 128-bit digests with their counts, whatever a row's width; partial aggregates make a
    hot duplicate one row per task.  Only rows whose digest is not alone are then grouped by their
    content, so two different rows of one digest are never taken for duplicates.
    """
    digest = row_digest(df)
    met = df.select(*digest).groupBy("_d0", "_d1").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        F.col("_d0").alias("_m0"), F.col("_d1").alias("_m1"))
    met = materialize(met, "digests")
    if lookup_bytes(met.count(), 16.0) <= BROADCAST_BUDGET:
        met = F.broadcast(met)
    again = df.select("*", *digest).join(met, (F.col("_d0") == F.col("_m0")) & (F.col("_d1") == F.col("_m1")), "left_semi")
    groups = again.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def amount_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "amount" in c.lower()]


def amount_sign_issues(df: DataFrame) -> DataFrame:
    """Negative and zero values summed over every column whose name holds 'amount'."""
    cols = amount_columns(df)
    neg = [F.count_if(_numeric(df, c) < 0) for c in cols]
    zero = [F.count_if(_numeric(df, c) == 0) for c in cols]
    total = (lambda xs: sum(xs[1:], xs[0]) if xs else F.lit(0))
    return df.agg(total(neg).cast("long").alias("negative_amounts"),
                  total(zero).cast("long").alias("zero_amounts"))


def iqr_outliers(df: DataFrame, path: str = "auto") -> DataFrame:
    """Per amount column: Q1, Q3 and the count strictly outside 1.5 IQR."""
    out = None
    for c in amount_columns(df):
        num = df.select(_numeric(df, c).alias("x"))
        q = quantile_table(num, "x", [0.25, 0.75], ["q1", "q3"], path=path)
        iqr = F.col("q3") - F.col("q1")
        lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
        cnt = (num.crossJoin(F.broadcast(q))  # one-row side
               .agg(F.first("q1").alias("q1"), F.first("q3").alias("q3"),
                    F.count_if((F.col("x") < lo) | (F.col("x") > hi)).alias("outliers")))
        part = cnt.select(F.lit(c).alias("column"), "q1", "q3", "outliers")
        out = part if out is None else out.unionByName(part)
    if out is None:
        schema = "column string, q1 double, q3 double, outliers long"
        return df.sparkSession.createDataFrame([], schema)
    return out


def column_types(df: DataFrame) -> DataFrame:
    """Column name, type name and number of present values (one aggregate over all columns)."""
    present = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"n{i}") for i, f in enumerate(df.schema.fields)])
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("data_type"),
                              F.col(f"n{i}").alias("present")) for i, f in enumerate(df.schema.fields)])
    return present.select(F.inline(rows))


def quality_report(df: DataFrame) -> dict:
    """All checks of the reference's quality panel as DataFrames."""
    return {"missing_values": missing_counts(df), "duplicate_rows": duplicate_rows(df),
            "amount_sign_issues": amount_sign_issues(df), "outliers": iqr_outliers(df),
            "data_types": column_types(df)}
