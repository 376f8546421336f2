"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's parquet tables through the FX views, runs
the operator over the whole view, and returns ``canonical`` output: doubles
rounded to 6 places (engines sum in different orders) and timestamps as ISO
text; the oracle SQL does the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import scalar as X
from ..operators import charts, detect, evaluate, features, profile, quality
from ..operators.ranks import dense_codes, order_statistics
from ..sources import ingest, ordering
from ..sources.tables import FIXTURE_MAPPINGS, QUOTED_SQL, fixture, read_table
from . import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


TS_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def canonical(df: DataFrame) -> DataFrame:
    """Output form for the cross-engine check: doubles rounded to 6 places,
    timestamps as ISO text with microseconds (both engines print them alike)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 6)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, TS_TEXT)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def raw(spark, sf, fx):
    return fixture(spark, sf, fx)


def processed(spark, sf, fx, want=None, path="auto"):
    """The processed table; ``want`` limits the dataset-relative features to those that are read."""
    return features.build_features(fixture(spark, sf, fx), FIXTURE_MAPPINGS[fx], want=want, path=path)


def cleaned(spark, sf, fx):
    """The row-local part only."""
    return features.clean(fixture(spark, sf, fx), FIXTURE_MAPPINGS[fx])


def renamed(spark, sf, fx):
    return features.rename_mapped(fixture(spark, sf, fx), FIXTURE_MAPPINGS[fx])


# --- sources / mapping --------------------------------------------------------

@query("preview")
def _preview(spark, sf):
    return canonical(ingest.preview(raw(spark, sf, "fx1"), "transaction_id"))


@query("dataset_shape")
def _shape(spark, sf):
    """Rows and columns of the uploaded table (the preview's shape line)."""
    n_rows, n_columns = ingest.shape(raw(spark, sf, "fx1"))
    return spark.createDataFrame([(n_rows, n_columns)], "n_rows long, n_columns int")


@query("readable_sample")
def _readable(spark, sf):
    """The readability gate on a whole table written as CSV, on one of a single column and on an empty one."""
    from ..session import scratch_path
    df = raw(spark, sf, "fx7")
    cases = {"table": df, "one_column": df.select("transaction_id"), "empty": df.limit(0)}
    rows = [(name, *ingest.readable_sample(spark, ingest.export_csv(part, scratch_path(spark, "csv"))))
            for name, part in cases.items()]
    return spark.createDataFrame(rows, "input string, ok boolean, message string")


@query("validate_source")
def _validate_source(spark, sf):
    return detect.validate_source(raw(spark, sf, "fx1"))


for _fx in ["fx1", "fx2", "fx3", "fx4", "fx5", "fx6", "fx8"]:
    def _make(fx):
        def q(spark, sf):
            df = raw(spark, sf, fx)
            return detect.mapping_frame(spark, detect.detect_columns(df))
        return q
    QUERIES[f"detect_columns_{_fx}"] = _make(_fx)


@query("detect_columns_by_file")
def _detect_by_file(spark, sf):
    """fx1 as files that arrive one after the other: facts of each are stored, detection reads the facts."""
    from ..operators import facts
    from ..session import scratch_path
    folder, store = scratch_path(spark, "upload"), scratch_path(spark, "facts")
    raw(spark, sf, "fx1").repartition(3, "transaction_id").write.parquet(folder)
    files, read = sorted(spark.read.parquet(folder).inputFiles()), lambda paths: spark.read.parquet(*paths)
    facts.update_facts(spark, files[:-1], read, store)
    facts.update_facts(spark, files, read, store)
    return detect.mapping_frame(spark, facts.detect_from_facts(spark, store, files, read))


@query("rename_mapped")
def _rename(spark, sf):
    return canonical(renamed(spark, sf, "fx1"))


@query("validate_model_input")
def _vmi(spark, sf):
    return detect.validate_model_input(cleaned(spark, sf, "fx1"), ["amount", "is_fraud"])


# --- cleaning and features -----------------------------------------------------

@query("coerce_amount")
def _coerce(spark, sf):
    return canonical(features.coerce_amount(renamed(spark, sf, "fx4")).select("id", "amount"))


@query("filter_amount")
def _filter_amount(spark, sf):
    return canonical(features.filter_amount(renamed(spark, sf, "fx4")).select("id", "amount"))


@query("standardize_label")
def _std_label(spark, sf):
    df = renamed(spark, sf, "fx4")
    facts = features.collect_facts(df)
    out = features.standardize_label(features.filter_amount(df), facts.label_mode)
    return canonical(out.select("id", "amount", "is_fraud"))


@query("standardize_label_numeric")
def _std_label_numeric(spark, sf):
    """Label text of which no row is a known spelling: numbers above 0 count as fraud."""
    df = raw(spark, sf, "fx7").withColumn("label", F.expr(
        "case transaction_id % 4 when 0 then ' 2' when 1 then '-1' when 2 then 'x' end"))
    df = features.rename_mapped(df, {"amount": "amount", "fraud_label": "label"})
    facts = features.collect_facts(df)
    out = features.standardize_label(features.filter_amount(df), facts.label_mode)
    return out.select("transaction_id", "is_fraud")


@query("time_features")
def _time(spark, sf):
    return canonical(cleaned(spark, sf, "fx1").select(
        "transaction_id", "timestamp", "hour", "day_of_week", "is_weekend", "is_night",
        "is_business_hours"))


@query("time_features_us")
def _time_us(spark, sf):
    """Time text of the form MM/dd/yyyy HH:mm."""
    return canonical(cleaned(spark, sf, "fx8").select(
        "transaction_id", "timestamp", "hour", "day_of_week", "is_weekend", "is_night", "is_business_hours"))


@query("drop_bad_timestamp")
def _drop_ts(spark, sf):
    return canonical(processed(spark, sf, "fx6"))


def _wanted(fx, columns, want, path="auto"):
    return lambda spark, sf: canonical(processed(spark, sf, fx, want, path).select(*columns))


_CODES = ["merchant_encoded", "location_encoded", "card_type_encoded"]
_FREQ = ["merchant_frequency", "location_frequency", "card_type_frequency"]
_RARE = ["location_frequency", "location_frequency_log", "is_rare_location"]
# The rounded percentile ties at 6 places; the doubled rank beside it is exact.
_PCT = ["amount_percentile", "amount_rank2"]
QUERIES.update({
    "category_codes": _wanted("fx2", ["transaction_id", "merchant", *_CODES], _CODES),
    "category_frequency": _wanted("fx2", ["transaction_id", *_FREQ], _FREQ),
    "rarity_flags": _wanted("fx1", ["transaction_id", *_RARE], _RARE),
    "amount_percentile": _wanted("fx3", ["amount", *_PCT], _PCT),
    "is_high_amount": _wanted("fx2", ["transaction_id", "amount", "is_high_amount"], ["is_high_amount"]),
    # The same rules through range-partitioned rank tables, the plan for many distinct values.
    "category_codes_ranged": _wanted("fx2", ["transaction_id", "merchant", *_CODES], _CODES, "ranged"),
    "amount_percentile_ranged": _wanted("fx3", ["amount", *_PCT], _PCT, "ranged"),
    "is_high_amount_ranged": _wanted("fx2", ["transaction_id", "amount", "is_high_amount"], ["is_high_amount"], "ranged"),
})


# A category with missing values: code -1, no frequency.
QUERIES["category_codes_missing"] = _wanted(
    "fx8", ["transaction_id", "merchant", "merchant_encoded", "merchant_frequency"], ["merchant_encoded", "merchant_frequency"])


@query("amount_features")
def _amount_feats(spark, sf):
    return canonical(cleaned(spark, sf, "fx1").select(
        "transaction_id", "amount", "amount_log", "amount_rounded"))


for _fx in ["fx1", "fx2", "fx3"]:
    def _make_bf(fx):
        return lambda spark, sf: canonical(processed(spark, sf, fx))
    QUERIES[f"build_features_{_fx}"] = _make_bf(_fx)


# --- profiling -------------------------------------------------------------------

def _on(fx, op):
    return lambda spark, sf: canonical(op(processed(spark, sf, fx)))


def _on_clean(fx, op):
    """For operators that read no dataset-relative feature."""
    return lambda spark, sf: canonical(op(cleaned(spark, sf, fx)))


#: Bounds a user would give; rows lie below, within and above them.
FRAUD_RANGE = (20.0, 160.0)


def _ranked_fraud(df):
    """Fraud rows in amount order with their place in it, so the order itself is in the result."""
    ordered = profile.fraud_by_amount(df, "transaction_id")
    st = order_statistics(ordered.select(F.struct((-F.col("amount")).alias("a"), "transaction_id").alias("k")), "k")
    place = dense_codes(st).select(F.col("value.transaction_id").alias("_id"), (F.col("code") + 1).alias("place"))
    return ordered.join(place, F.col("transaction_id") == F.col("_id")).drop("_id")


QUERIES.update({
    "headline_metrics": _on_clean("fx1", profile.headline_metrics),
    "headline_metrics_fx2": _on_clean("fx2", profile.headline_metrics),
    "fraud_counts": _on_clean("fx1", profile.fraud_counts),
    "amount_stats_by_class": _on_clean("fx2", profile.amount_stats_by_class),
    "total_fraud_amount": _on_clean("fx1", profile.total_fraud_amount),
    "fraud_by_hour": _on_clean("fx1", profile.fraud_by_hour),
    "top_fraud_location": _on_clean("fx1", lambda d: profile.top_fraud_category(d, "location")),
    "top_fraud_card_type": _on_clean("fx1", lambda d: profile.top_fraud_category(d, "card_type")),
    "top_fraud_merchant": _on_clean("fx2", lambda d: profile.top_fraud_category(d, "merchant")),
    "fraud_distribution": _on_clean("fx1", profile.fraud_distribution),
    "daily_timeline": _on_clean("fx1", profile.daily_timeline),
    "daily_timeline_join": _on_clean("fx1", profile.daily_timeline_join),
    "amount_histogram": _on_clean("fx1", profile.amount_histogram),
    "correlation_matrix": _on("fx1", charts.correlation_matrix),
    "fraud_rows": _on("fx1", profile.fraud_rows),
    "legit_rows": _on("fx1", profile.legit_rows),
    "fraud_head": _on("fx1", lambda d: profile.fraud_head(d, "transaction_id")),
    "fraud_by_amount": _on_clean("fx1", _ranked_fraud),
    "fraud_amount_range": _on_clean("fx1", lambda d: profile.fraud_by_amount(
        profile.fraud_amount_range(d, *FRAUD_RANGE), "transaction_id")),
    "amount_stats_by_class_ranged": _on_clean("fx2", lambda d: profile.amount_stats_by_class(d, path="ranged")),
    "fraud_amount_maximum": _on_clean("fx1", profile.fraud_amount_max),
    "daily_timeline_us": _on_clean("fx8", profile.daily_timeline),
    "top_fraud_merchant_category": _on_clean("fx8", lambda d: profile.top_fraud_category(d, "merchant")),
    "class_weights": _on_clean("fx1", profile.class_weights),
    "summary_report": lambda spark, sf: flows.summary_report(processed(spark, sf, "fx2")),
})


# --- quality -----------------------------------------------------------------------

QUERIES.update({
    "basic_stats": lambda spark, sf: canonical(quality.basic_stats(raw(spark, sf, "fx4"), "amount")),
    "basic_stats_ranged": lambda spark, sf: canonical(quality.basic_stats(raw(spark, sf, "fx4"), "amount", path="ranged")),
    "iqr_outliers_amount": lambda spark, sf: canonical(quality.iqr_outliers(raw(spark, sf, "fx7"))),
    "missing_counts": lambda spark, sf: quality.missing_counts(raw(spark, sf, "fx5")),
    "duplicate_rows": lambda spark, sf: quality.duplicate_rows(raw(spark, sf, "fx5")),
    "amount_sign_issues": lambda spark, sf: quality.amount_sign_issues(raw(spark, sf, "fx5")),
    "iqr_outliers": lambda spark, sf: canonical(quality.iqr_outliers(raw(spark, sf, "fx5"))),
    "column_types": lambda spark, sf: quality.column_types(raw(spark, sf, "fx5")),
})


# --- scored rows ---------------------------------------------------------------------

def _fx7(op):
    return lambda spark, sf: canonical(op(raw(spark, sf, "fx7")))


QUERIES.update({
    "classification_metrics": _fx7(evaluate.classification_metrics),
    "roc_auc": _fx7(evaluate.roc_auc),
    "roc_auc_ranged": _fx7(lambda d: evaluate.roc_auc(d, path="ranged")),
    "prediction_summary": _fx7(evaluate.prediction_summary),
    "high_risk_api": _fx7(lambda d: profile.high_risk(d, S.HIGH_RISK_API, "input", "transaction_id")),
    "high_risk_ui": _fx7(lambda d: profile.high_risk(d, S.HIGH_RISK_UI, "probability",
                                                     "transaction_id")),
    "score_rows": _fx7(evaluate.prediction_correct),
    "amount_vs_probability": _fx7(evaluate.amount_vs_probability),
    "pseudo_probability": _fx7(lambda d: d.select(
        "transaction_id", "predicted_fraud",
        evaluate.pseudo_probability(F.col("predicted_fraud")).alias("fraud_probability"))),
    "format_currency": _fx7(lambda d: d.select(
        "transaction_id", X.format_currency(F.col("amount")).alias("amount_text"))),
    "format_percentage": _fx7(lambda d: d.select(
        "transaction_id", X.format_percentage(F.col("fraud_probability")).alias("probability_text"))),
})


@query("union_sources")
def _union(spark, sf):
    """Two sources of different columns as one table: by name, missing columns null."""
    a = raw(spark, sf, "fx7").select("transaction_id", "amount", "is_fraud")
    b = raw(spark, sf, "fx4").select(F.col("id").alias("transaction_id"), F.col("fraud").alias("note"))
    return canonical(ingest.union_sources([a, b, a.where("is_fraud = 1")]))


@query("union_sources_types")
def _union_types(spark, sf):
    """Sources whose columns clash in type: whole and broken numbers, numbers and text, truth values and numbers."""
    df = raw(spark, sf, "fx7")
    a = df.select("transaction_id", F.expr("cast(transaction_id % 7 as int)").alias("code"), (F.col("is_fraud") == 1).alias("flag"),
                  F.expr("cast(transaction_id % 100 as int)").alias("amount"))
    b = df.select("transaction_id", F.expr("concat('x', transaction_id % 5)").alias("code"), F.col("is_fraud").alias("flag"), "amount")
    c = df.select("transaction_id", (F.col("transaction_id") * 3).alias("code"), F.lit(None).cast("boolean").alias("flag"))
    return canonical(ingest.union_sources([a, b, c]))


# --- file order ------------------------------------------------------------------------------

def _placed(spark, sf, fx):
    """The cleaned table with each row's place in the files."""
    return features.clean(fixture(spark, sf, fx, position=True), FIXTURE_MAPPINGS[fx])


@query("preview_file_order")
def _preview_file_order(spark, sf):
    return canonical(ordering.preview(read_table(spark, sf, "lineitem"), 10))


@query("row_numbers")
def _row_numbers(spark, sf):
    """Every row with its number in the file, as a data frame's index has it."""
    return canonical(ordering.with_row_number(fixture(spark, sf, "fx3", position=True)).select(
        "row_number", "amount", "label", "vendor"))


@query("fraud_head_file_order")
def _fraud_head_file_order(spark, sf):
    df = profile.fraud_head(_placed(spark, sf, "fx3"), ordering.POSITION)
    return canonical(df.select("amount", "merchant", "card_type", "is_fraud"))


@query("high_risk_file_order")
def _high_risk_file_order(spark, sf):
    df = profile.high_risk(fixture(spark, sf, "fx7", position=True), S.HIGH_RISK_API, "input", ordering.POSITION)
    return canonical(df.drop(ordering.POSITION))


for _name, _fx, _col in (("top_fraud_location_first_seen", "fx1", "location"), ("top_fraud_merchant_first_seen", "fx8", "merchant")):
    QUERIES[_name] = (lambda fx, col: lambda spark, sf: canonical(profile.top_fraud_category(_placed(spark, sf, fx), col)))(_fx, _col)


@query("merchant_risk")
def _merchant_risk(spark, sf):
    df = cleaned(spark, sf, "fx8")
    m = F.create_map(*[x for k, v in S.MERCHANT_RISK.items() for x in (F.lit(k), F.lit(v))])
    return canonical(df.select("transaction_id", "merchant", F.coalesce(
        F.element_at(m, F.col("merchant")), F.lit(S.DEFAULT_MERCHANT_RISK)).alias("merchant_risk_score")))


# --- models (rows-only: no SQL restatement of a fitted model) --------------------------

def _train(algorithm: str, cv: bool):
    def q(spark, sf):
        from . import ml
        _, metrics = ml.train_model(processed(spark, sf, "fx1"), algorithm, cross_validation=cv)
        return canonical(ml.metrics_frame(spark, algorithm, metrics))
    return q


QUERIES.update({
    "train_rf": _train("random_forest", False),
    "train_gbt": _train("xgboost", False),
    "train_logreg": _train("logistic_regression", False),
    "train_svm": _train("svm", False),
    "cross_validate": _train("logistic_regression", True),
})


@query("stratified_split")
def _split(spark, sf):
    """Train or test for every row."""
    from . import ml
    df = cleaned(spark, sf, "fx1").select("transaction_id", "is_fraud")
    train, test = ml.stratified_split(df, 0.2, 42, label="is_fraud")
    return (train.withColumn("split", F.lit("train"))
            .unionByName(test.withColumn("split", F.lit("test"))))


@query("stratified_folds")
def _folds(spark, sf):
    """The fold of every row."""
    from . import ml
    df = cleaned(spark, sf, "fx1").select("transaction_id", "is_fraud")
    return df.withColumn("fold", ml.fold_column(df, 5, 42, label="is_fraud"))


@query("assemble_features")
def _assemble(spark, sf):
    """The model input, one column per feature: missing numbers 0."""
    from . import ml
    df = processed(spark, sf, "fx1")
    spec = ml.feature_spec(df)
    data = ml.prepare(df, spec)
    return canonical(data.select("transaction_id", "label", *spec.numeric))


@query("assemble_features_missing")
def _assemble_missing(spark, sf):
    """The model input of a table with missing categories: their code is -1, their frequency 0."""
    from . import ml
    df = processed(spark, sf, "fx8")
    return canonical(ml.prepare(df, ml.feature_spec(df)).select(
        "transaction_id", "label", "merchant_encoded", "merchant_frequency", "merchant_frequency_log", "is_rare_merchant"))


@query("scale_features")
def _scale(spark, sf):
    """Every row through the scaler that training fits: (x - mean) / population deviation."""
    from . import ml
    df = processed(spark, sf, "fx1")
    spec = ml.feature_spec(df)
    data = ml.prepare(df, spec).select("transaction_id", *spec.numeric)
    out = ml.fit_scaler(data, spec.numeric).transform(data)
    # One pass in another order moves the last digits of mean and deviation: five places hold.
    return out.select("transaction_id", *[(F.round(F.col(f"_z_{c}"), 5) + F.lit(0.0)).alias(c) for c in spec.numeric])


@query("encode_text")
def _encode(spark, sf):
    """Codes fitted on three quarters of the orders, applied to all: unseen texts get the next code."""
    from . import ml
    data = raw(spark, sf, "fx2").select("transaction_id", F.concat("country", F.lit("-"), F.expr(
        "cast(customer_id as string)")).alias("place"), "merchant_name", "payment_method")
    data = ml.prepare(data, ml.FeatureSpec([], ["place", "merchant_name", "payment_method"]))
    codes, sizes = ml.fit_codes(data.where("transaction_id % 4 <> 0"), ["place", "merchant_name", "payment_method"])
    out = ml.encode(data, codes, sizes)
    return out.select("transaction_id", *[F.col(f"_idx_{c}").cast("int").alias(f"{c}_code") for c in codes])


@query("align_features")
def _align(spark, sf):
    from . import ml
    ref = ml.feature_spec(processed(spark, sf, "fx1"))
    return canonical(ml.align_features(processed(spark, sf, "fx6"), ["transaction_id"] + ref.numeric))


@query("score_model")
def _score_model(spark, sf):
    """Train, save, load from the path alone and score every row of the table.

    The flags are what an oracle can check: a probability in range, the prediction on its side of
    0.5, correctness against the label.
    """
    from . import ml
    from ..session import scratch_path
    df = processed(spark, sf, "fx1")
    model, _ = ml.train_model(df, "logistic_regression", cross_validation=False)
    path = ml.save_model(model, scratch_path(spark, "model"))
    scored = ml.score(ml.load_model(path, spark), df)
    p = F.col("fraud_probability")
    return scored.select(
        "transaction_id", "is_fraud", p.between(0.0, 1.0).alias("in_range"),
        (F.col("predicted_fraud") == (p > 0.5).cast("int")).alias("consistent"),
        (F.col("prediction_correct") == (F.col("predicted_fraud") == F.col("is_fraud"))).alias("flag_right"))


@query("score_model_summary")
def _score_summary(spark, sf):
    """The same scored rows as the report shows them."""
    from . import ml
    df = processed(spark, sf, "fx1")
    model, _ = ml.train_model(df, "logistic_regression", cross_validation=False)
    return evaluate.prediction_summary(ml.score(model, df))


# --- sources and sinks (round trips through the checkpoint folder) ----------------------

@query("scan_csv")
def _scan_csv(spark, sf):
    """The dirty fx4 table written as CSV and scanned back with pandas' rules."""
    from ..session import scratch_path
    from ..sources import ingest
    path = ingest.export_csv(raw(spark, sf, "fx4"), scratch_path(spark, "csv"))
    schema = "id long, amount string, fraud string"
    return ingest.scan_csv(spark, path, schema=schema)


@query("scan_csv_inferred")
def _scan_inferred(spark, sf):
    """Types inferred over a file whose numeric columns hold NA, N/A and empty cells, then the label rule."""
    from ..session import scratch_path
    df = raw(spark, sf, "fx7").select(
        "transaction_id",
        F.expr("case transaction_id % 10 when 3 then 'N/A' when 4 then null else cast(round(amount, 2) as string) end").alias("amount"),
        F.expr("case transaction_id % 5 when 0 then 'NA' when 1 then '1' else '0' end").alias("label"),
        F.expr("case transaction_id % 3 when 0 then 'null' else 'a' end").alias("note"))
    path = ingest.export_csv(df, scratch_path(spark, "csv"))
    back = features.rename_mapped(ingest.scan_csv(spark, path), {"amount": "amount", "fraud_label": "label"})
    facts = features.collect_facts(back)
    out = features.standardize_label(features.filter_amount(back), facts.label_mode)
    types = ",".join(f"{c}:{t}" for c, t in sorted(back.dtypes))
    return canonical(out.select("transaction_id", "amount", "note", "is_fraud", F.lit(types).alias("types")))


@query("scan_csv_quoted")
def _scan_quoted(spark, sf):
    """Values with quotes, separators, line ends and backslashes and 19-digit ids, out as CSV and in with inferred types."""
    from ..session import scratch_path
    raw(spark, sf, "fx7").createOrReplaceTempView("fx7")
    path = ingest.export_csv(spark.sql(QUOTED_SQL), scratch_path(spark, "csv"))
    back = ingest.scan_csv(spark, path)
    types = ",".join(f"{c}:{t}" for c, t in sorted(back.dtypes))
    return canonical(back.withColumns({"reference": F.col("reference").cast("string"), "types": F.lit(types)}))


@query("scan_csv_rejects")
def _scan_rejects(spark, sf):
    """A file with unquoted separators and bad numbers: every record is a good row or a reject with its cause."""
    from ..session import scratch_path
    df = raw(spark, sf, "fx7").select(
        "transaction_id", F.expr("case when transaction_id % 7 = 0 then 'abc' when transaction_id % 11 = 0 then 'NA' else cast(transaction_id as string) end").alias("amount"),
        F.expr("case when transaction_id % 13 = 0 then 'a,b' else 'plain' end").alias("note"))
    path = scratch_path(spark, "csv")
    df.write.option("header", True).option("quote", "\u0000").csv(path)  # as a careless writer leaves it
    good, rejects = ingest.scan_csv_rejects(spark, path, "transaction_id long, amount double, note string")
    bad = rejects.select(F.split("record", ",")[0].cast("long").alias("transaction_id"), F.lit(None).cast("double").alias("amount"), "cause")
    return canonical(good.select("transaction_id", "amount", F.lit("good").alias("cause")).unionByName(bad))


@query("export_json")
def _export_json(spark, sf):
    """fx7 rows out as JSON records and back in."""
    from ..session import scratch_path
    from ..sources import ingest
    df = raw(spark, sf, "fx7")
    path = ingest.export_json(df, scratch_path(spark, "json"))
    return canonical(ingest.records_in(spark, path, df.schema))


@query("export_csv")
def _export_csv(spark, sf):
    """Processed fraud rows of fx1 written as CSV and read back."""
    from ..session import scratch_path
    from ..sources import ingest
    df = profile.fraud_rows(processed(spark, sf, "fx1")).select(
        "transaction_id", "amount", "location", "card_type", "is_fraud", "amount_percentile")
    path = ingest.export_csv(df, scratch_path(spark, "csv"))
    return canonical(ingest.scan_csv(spark, path, schema=df.schema))
