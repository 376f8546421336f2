"""End-to-end flows of the reference's pages, as Spark jobs.

``analyse``: detect -> build features -> every analysis dataset.
``summary_report``: the text report as (section, metric, value) rows.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import charts, detect, evaluate, profile
from ..operators.features import build_features


def analyse(raw: DataFrame, mapping: dict | None = None, persist: bool = False) -> dict:
    """Analysis results of the upload page: lazy DataFrames keyed like the reference.

    ``persist=True`` keeps the processed table (MEMORY_AND_DISK) for the ~10
    actions that follow; the default re-reads the column-pruned source per
    action, which is cheaper when the table is much larger than memory.
    The caller unpersists ``result["processed"]`` when done.
    """
    if mapping is None:
        mapping = detect.detect_columns(raw)
        failed = detect.failed_timestamp(raw, mapping)
        if failed:  # the processed table has no timestamp then, and its raw text is no feature
            raw = raw.drop(failed)
    df = build_features(raw, mapping)
    if persist:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = {
        "processed": df,
        "fraud_transactions": profile.fraud_rows(df),
        "legitimate_transactions": profile.legit_rows(df),
        "headline_metrics": profile.headline_metrics(df),
        "fraud_counts": profile.fraud_counts(df),
        "amount_stats": profile.amount_stats_by_class(df),
        "fraud_distribution": profile.fraud_distribution(df),
        "amount_histogram": profile.amount_histogram(df),
        "correlation": charts.correlation_matrix(df),
        "scatter": evaluate.amount_vs_probability(df, None),
    }
    if "hour" in df.columns:
        out["fraud_by_hour"] = profile.fraud_by_hour(df)
    if "timestamp" in df.columns:
        out["daily_timeline"] = profile.daily_timeline(df)
    for c in S.CATEGORICAL_FIELDS:
        if c in df.columns:
            out[f"top_fraud_{c}"] = profile.top_fraud_category(df, c)
    if "merchant" not in df.columns and "merchant_category" in df.columns:  # either name is charted
        out["top_fraud_merchant"] = profile.top_fraud_category(df, "merchant_category")
    return out


def _money(c):
    return F.format_string("%.2f", c)


def summary_report(df: DataFrame) -> DataFrame:
    """The text report as rows; the text itself is ``report_text`` of these rows.

    Every figure is computed by one aggregate (plus the top-5 merchant list).
    """
    spark = df.sparkSession
    fr = profile.fraud_flag()
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(fr).alias("f"),
            F.avg(F.when(fr, F.col("amount"))).alias("m"),
            F.sum(F.when(fr, F.col("amount"))).alias("s")]
    has_ts = "timestamp" in df.columns
    if has_ts:
        aggs += [F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1")]
    a = df.agg(*aggs)
    med = (profile.amount_stats_by_class(df).where(F.col("is_fraud") == 1)
           .select(F.col("median").alias("med")))
    a = a.crossJoin(med)  # both one row
    date_range = (F.concat(F.lit("Date Range: "), F.col("t0").cast("string"), F.lit(" to "),
                           F.col("t1").cast("string")) if has_ts
                  else F.lit("Date Range: Not available"))
    rate = F.format_string("%.2f%%", F.col("f") * 100.0 / F.col("n"))
    rows = [
        ("overview", 1, "total_transactions", F.concat(F.lit("Total Transactions: "), F.format_number(F.col("n"), 0))),
        ("overview", 2, "columns", F.lit(f"Number of Columns: {len(df.columns)}")),
        ("overview", 3, "date_range", date_range),
        ("fraud", 4, "fraud_transactions", F.concat(F.lit("Fraud Transactions: "), F.format_number(F.col("f"), 0))),
        ("fraud", 5, "legitimate_transactions",
         F.concat(F.lit("Legitimate Transactions: "), F.format_number(F.col("n") - F.col("f"), 0))),
        ("fraud", 6, "fraud_rate", F.concat(F.lit("Fraud Rate: "), rate)),
        ("amount", 7, "average_fraud_amount",
         F.concat(F.lit("Average Fraud Amount: $"), _money(F.coalesce(F.col("m"), F.lit(0.0))))),
        ("amount", 8, "total_fraud_amount",
         F.concat(F.lit("Total Fraud Amount: $"), F.format_number(F.coalesce(F.col("s"), F.lit(0.0)), 2))),
        ("amount", 9, "median_fraud_amount",
         F.concat(F.lit("Median Fraud Amount: $"), _money(F.coalesce(F.col("med"), F.lit(0.0))))),
    ]
    body = a.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(i).cast("long").alias("line"), F.lit(k).alias("metric"),
                 v.alias("value")) for s, i, k, v in rows])))
    if "merchant" in df.columns:
        top = profile.top_fraud_category(df, "merchant", S.REPORT_TOP_MERCHANTS)
        top = top.select(
            F.lit("top_merchants").alias("section"),
            # Numbering the (at most five) listed rows.
            (F.lit(10).cast("long") + F.row_number().over(
                Window.orderBy(F.col("fraud_count").desc(), F.col("merchant").asc()))).alias("line"),
            F.col("merchant").alias("metric"),
            F.format_string("- %s: %d transactions", F.col("merchant"), F.col("fraud_count")).alias("value"))
        body = body.unionByName(top)
    return body


def report_text(report: DataFrame) -> str:
    """Join the report rows into the reference's text layout (the rows are few)."""
    lines = ["=== FRAUD DETECTION ANALYSIS REPORT ===\n", "DATASET OVERVIEW:"]
    rows = sorted(report.collect(), key=lambda r: r["line"])
    sections = {"fraud": "FRAUD STATISTICS:", "amount": "AMOUNT ANALYSIS:",
                "top_merchants": "TOP FRAUD MERCHANTS:"}
    current = "overview"
    for r in rows:
        if r["section"] != current:
            lines.append("")
            lines.append(sections[r["section"]])
            current = r["section"]
        lines.append(r["value"])
    lines += ["", "=== END OF REPORT ==="]
    return "\n".join(lines)
