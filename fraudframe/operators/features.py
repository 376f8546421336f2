"""Cleaning and feature building: raw transaction table -> processed table.

``clean`` is row-local: rename mapped columns -> coerce amount, drop missing / negative ->
standardise the label (text spellings, numeric fallback), drop unmapped -> parse the timestamp (a
column with any bad value is dropped) -> hour, weekday, weekend, night / business-hours flags ->
log amount, whole-amount flag.  Its two data-dependent decisions (numeric label fallback,
dropping a bad timestamp column) take at most one small aggregate, and none where the column
types decide alone.

``enrich`` adds the dataset-relative features, only those asked for: per categorical sorted-order
code and frequency (log, rarity flag), average-rank percentile, above-p95 flag.  They come from
``order_statistics`` lookup tables joined back to the rows: broadcast within one byte budget for
the whole plan, shuffle-joined (AQE splits skewed keys) beyond it.  ``build_features`` is both.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import scalar as X
from ..functions import timeformat
from .ranks import average_rank_pct, dense_codes, order_statistics, quantile_table, quantiles

# All lookups of one plan share this broadcast budget (bytes as the estimate has them: rows with a
# 10% margin times key bytes and the cost of a hashed row); what does not fit is joined by shuffle.
BROADCAST_BUDGET = 256 * 1024 * 1024
LOOKUP_ROW_BYTES = 96  # hashed relation: row header, pointer, key and value words, load factor


@dataclass
class FeatureFacts:
    label_mode: str = "map"            # "map" or "numeric"
    timestamp_dropped: bool = False
    timestamp_format: str | None = None
    bad_timestamps: int = 0
    broadcast_left: float = BROADCAST_BUDGET
    lookup_sizes: dict = field(default_factory=dict)
    distinct_estimates: dict = field(default_factory=dict)
    key_widths: dict = field(default_factory=dict)


def rename_mapped(df: DataFrame, mapping: dict) -> DataFrame:
    """Source columns -> canonical names.  A source named twice keeps the last target."""
    rename = {}
    for canon, src in mapping.items():
        if src and src in df.columns:
            rename[src] = canon
    return df.withColumnsRenamed(rename) if rename else df


def _dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def amount_column(df: DataFrame) -> Column:
    return X.to_number(F.col("amount"), _dtype(df, "amount"))


def coerce_amount(df: DataFrame) -> DataFrame:
    """``amount`` as double; values that are not numbers become null."""
    if "amount" not in df.columns:
        raise ValueError("Amount column is required but not found")
    return df.withColumn("amount", amount_column(df))


def filter_amount(df: DataFrame) -> DataFrame:
    """Keep rows with a present, non-negative amount, then coerce.

    For a numeric source column the condition is stated on the raw column, so
    ``IS NOT NULL`` and ``>= 0`` reach the parquet scan as pushed filters (only
    the NaN test stays behind); text amounts are filtered after parsing.
    """
    if "amount" not in df.columns:
        raise ValueError("Amount column is required but not found")
    dtype = _dtype(df, "amount")
    raw = F.col("amount")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return coerce_amount(df.where(raw.isNotNull() & (raw >= 0) & ~F.isnan(raw)))
    if isinstance(dtype, T.NumericType):
        return coerce_amount(df.where(raw.isNotNull() & (raw >= 0)))
    df = coerce_amount(df)
    return df.where(F.col("amount").isNotNull() & (F.col("amount") >= 0))


def _label_always_numeric(dtype: T.DataType) -> bool:
    # A double label prints as '1.0' and never matches a spelling.
    return isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType))


def collect_facts(df: DataFrame, on_bad_timestamp: str = "drop") -> FeatureFacts:
    """The data-dependent branches of ``clean``: one aggregate over the columns they need (two for times in text)."""
    if "fraud_label" not in df.columns:
        raise ValueError("Fraud label column is required but not found")
    ldt = _dtype(df, "fraud_label")
    always = _label_always_numeric(ldt)
    text_time = "timestamp" in df.columns and isinstance(_dtype(df, "timestamp"), T.StringType)
    facts = FeatureFacts(label_mode="numeric" if always else "map")
    if always and not text_time:
        return facts
    amount_ok = amount_column(df).isNotNull() & (amount_column(df) >= 0)
    mapped = X.mapped_label(F.col("fraud_label")).isNotNull()
    aggs = [F.count_if(amount_ok & mapped).alias("mapped"),
            F.count_if(F.col("fraud_label").isNull()).alias("label_nulls")]
    if text_time:
        raw = F.col("timestamp")
        present = X.strip_text(raw).isNotNull()
        forms = timeformat.candidates(df, "timestamp", amount_ok)
        for i, fmt in enumerate(forms):
            bad = present & X.parse_timestamp(raw, _dtype(df, "timestamp"), fmt).isNull()
            aggs += [F.count_if(amount_ok & mapped & bad).alias(f"bad_mapped{i}"),
                     F.count_if(amount_ok & bad).alias(f"bad_all{i}")]
    r = df.agg(*aggs).first()
    if not always:
        numeric = (isinstance(ldt, T.IntegralType) and r["label_nulls"] > 0) or r["mapped"] == 0
        facts.label_mode = "numeric" if numeric else "map"
    if text_time:
        which = "bad_all" if facts.label_mode == "numeric" else "bad_mapped"
        wrong = [int(r[f"{which}{i}"]) for i in range(len(forms))]
        facts.bad_timestamps = min(wrong)
        facts.timestamp_format = forms[wrong.index(facts.bad_timestamps)]
        facts.timestamp_dropped = facts.bad_timestamps > 0 and on_bad_timestamp == "drop"
    return facts


def collect_sizes(df: DataFrame, columns: list[str], facts: FeatureFacts) -> FeatureFacts:
    """Distinct estimates and key bytes of the lookups to come (one aggregate)."""
    columns = [c for c in columns if c not in facts.distinct_estimates]
    if columns:
        aggs = [F.approx_count_distinct(c, 0.02).alias(f"_d_{c}") for c in columns]
        aggs += [F.avg(F.octet_length(F.col(c).cast("string"))).alias(f"_w_{c}") for c in columns if c != "amount"]
        r = df.agg(*aggs).first()
        facts.distinct_estimates.update({c: r[f"_d_{c}"] for c in columns})
        facts.key_widths.update({c: 8.0 if c == "amount" else float(r[f"_w_{c}"] or 0.0) for c in columns})
    return facts


def standardize_label(df: DataFrame, mode: str) -> DataFrame:
    """``is_fraud`` 0/1 from the label column; unmapped rows removed (map mode)."""
    ldt = _dtype(df, "fraud_label")
    if mode == "numeric":
        return df.withColumn("is_fraud", X.numeric_label(F.col("fraud_label"), ldt))
    return (df.withColumn("is_fraud", X.mapped_label(F.col("fraud_label")))
            .where(F.col("is_fraud").isNotNull()))


def time_features(df: DataFrame, drop: bool, fmt: str | None = None) -> DataFrame:
    """Parsed timestamp plus hour, day_of_week (Monday=0) and is_weekend."""
    if "timestamp" not in df.columns:
        return df
    if drop:
        return df.drop("timestamp")
    ts = X.parse_timestamp(F.col("timestamp"), _dtype(df, "timestamp"), fmt)
    df = df.withColumn("timestamp", ts)
    return df.withColumns({
        "hour": F.hour("timestamp"),
        "day_of_week": X.weekday_monday0(F.col("timestamp")),
    }).withColumn("is_weekend", X.is_weekend(F.col("day_of_week")))


def lookup_bytes(rows: int, key_width: float) -> float:
    return rows * (key_width + LOOKUP_ROW_BYTES)


def _join_lookup(df: DataFrame, lookup: DataFrame, key: str, size: int, facts: FeatureFacts) -> DataFrame:
    cost = lookup_bytes(size, facts.key_widths.get(key, 16.0))
    if cost <= facts.broadcast_left:
        facts.broadcast_left -= cost
        lookup = F.broadcast(lookup)
    return df.join(lookup, df[key] == lookup["value"], "left").drop("value")


def category_features(df: DataFrame, cols: list[str] | None = None, facts: FeatureFacts | None = None,
                      path: str = "auto") -> DataFrame:
    """``{c}_encoded`` (sorted distinct order, missing -1) and ``{c}_frequency``."""
    cols = [c for c in (cols or S.CATEGORICAL_FIELDS) if c in df.columns]
    facts = collect_sizes(df, cols, facts or FeatureFacts())
    # All statistics come from the input plan, before any lookup is joined.
    all_stats = {c: order_statistics(df, c, distinct_estimate=facts.distinct_estimates[c], path=path) for c in cols}
    for c in cols:
        stats = all_stats[c]
        facts.lookup_sizes[c] = stats.lookup_rows
        codes = dense_codes(stats).select("value", F.col("code").alias("_code"), F.col("freq").alias("_freq"))
        df = _join_lookup(df, codes, c, stats.lookup_rows, facts)
        df = df.withColumns({
            f"{c}_encoded": F.coalesce(F.col("_code"), F.lit(-1)).cast("int"),
            f"{c}_frequency": F.col("_freq"),
        }).drop("_code", "_freq")
    return df


def amount_flags(df: DataFrame) -> DataFrame:
    """Row-local amount features."""
    return df.withColumns({"amount_log": F.log1p("amount"), "amount_rounded": X.is_whole(F.col("amount"))})


def amount_features(df: DataFrame, facts: FeatureFacts | None = None, source: DataFrame | None = None,
                    want: set[str] | None = None, path: str = "auto") -> DataFrame:
    """amount_percentile (and its exact doubled rank) and is_high_amount, as wanted.

    ``source`` is the plan the rank table is computed from (defaults to df);
    pass the pre-join plan so the statistics job does not run the joins.
    """
    source = source if source is not None else df
    facts = collect_sizes(source, ["amount"], facts or FeatureFacts())
    ranks = want is None or not want.isdisjoint({"amount_percentile", "amount_rank2"})
    if ranks:
        stats = order_statistics(source, "amount", distinct_estimate=facts.distinct_estimates["amount"], path=path)
        facts.lookup_sizes["amount"] = stats.lookup_rows
    if want is None or "is_high_amount" in want:
        # A scalar subquery: it runs inside the final job.
        q = [S.HIGH_AMOUNT_QUANTILE], ["_q95"]
        table = quantiles(stats, *q) if ranks else quantile_table(
            source, "amount", *q, path=path, distinct_estimate=facts.distinct_estimates["amount"])
        q95 = table.select("_q95").scalar()
        df = df.withColumn("is_high_amount", F.coalesce(F.col("amount") > q95, F.lit(False)).cast("int"))
    if ranks:
        pct = average_rank_pct(stats, doubled=True).withColumnsRenamed({"pct": "_pct", "rank2": "_rank2"})
        df = _join_lookup(df, pct, "amount", stats.lookup_rows, facts)
        df = df.withColumn("amount_percentile", F.col("_pct"))
        if want is not None and "amount_rank2" in want:
            df = df.withColumn("amount_rank2", F.col("_rank2"))
        df = df.drop("_pct", "_rank2")
    return df


def hour_flags(df: DataFrame) -> DataFrame:
    if "hour" not in df.columns:
        return df
    return df.withColumns({"is_night": X.is_night(F.col("hour")),
                           "is_business_hours": X.is_business_hours(F.col("hour"))})


def rarity_flags(df: DataFrame) -> DataFrame:
    for c in S.RARITY_FIELDS:
        f = f"{c}_frequency"
        if f in df.columns:
            df = df.withColumns({f"{f}_log": F.log1p(F.col(f)), f"is_rare_{c}": X.is_rare(F.col(f))})
    return df


def clean(raw: DataFrame, mapping: dict, on_bad_timestamp: str = "drop", facts: FeatureFacts | None = None) -> DataFrame:
    """The row-local part: one row in, at most one row out, no table of its own."""
    df = rename_mapped(raw, mapping)
    if facts is None:
        facts = collect_facts(df, on_bad_timestamp)
    df = filter_amount(df)
    df = standardize_label(df, facts.label_mode)
    df = hour_flags(amount_flags(time_features(df, facts.timestamp_dropped, facts.timestamp_format)))
    return df.drop("fraud_label")


def _category_outputs(c: str) -> set[str]:
    return {f"{c}_encoded", f"{c}_frequency", f"{c}_frequency_log", f"is_rare_{c}"}


def enrich(df: DataFrame, want: list[str] | set[str] | None = None, facts: FeatureFacts | None = None,
           path: str = "auto") -> DataFrame:
    """Dataset-relative features over a cleaned table; ``want`` names the columns that will be read."""
    want = None if want is None else set(want)
    facts = facts or FeatureFacts()
    base = df
    cols = [c for c in S.CATEGORICAL_FIELDS
            if c in df.columns and (want is None or not want.isdisjoint(_category_outputs(c)))]
    amounts = want is None or not want.isdisjoint({"amount_percentile", "amount_rank2", "is_high_amount"})
    collect_sizes(base, cols + (["amount"] if amounts else []), facts)
    if cols:
        df = category_features(df, cols, facts, path)
    if amounts:
        df = amount_features(df, facts, base, want, path)
    return rarity_flags(df)


def build_features(raw: DataFrame, mapping: dict, on_bad_timestamp: str = "drop", return_facts: bool = False,
                   want: list[str] | set[str] | None = None, path: str = "auto"):
    """The processed table for ``raw`` under ``mapping`` (see module docstring)."""
    facts = collect_facts(rename_mapped(raw, mapping), on_bad_timestamp)
    df = enrich(clean(raw, mapping, on_bad_timestamp, facts), want, facts, path)
    return (df, facts) if return_facts else df
