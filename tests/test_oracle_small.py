"""Registered queries against their DuckDB restatements on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from fraudframe.sources.tables import BASE_TABLES
from tools.check_oracle import digest

from .conftest import SF_SMALL

FAST_KEYS = ["headline_metrics", "build_features_fx1", "build_features_fx2", "amount_stats_by_class",
             "fraud_by_hour", "top_fraud_location", "daily_timeline", "daily_timeline_join",
             "amount_histogram", "standardize_label", "drop_bad_timestamp", "classification_metrics",
             "roc_auc", "high_risk_ui", "duplicate_rows", "iqr_outliers", "basic_stats",
             "detect_columns_fx1", "detect_columns_fx6", "summary_report",
             "correlation_matrix", "scan_csv", "export_json", "column_types", "dataset_shape",
             "encode_text", "align_features", "merchant_risk", "stratified_split", "stratified_folds",
             "assemble_features", "scale_features", "scan_csv_inferred", "time_features_us", "detect_columns_fx8",
             "daily_timeline_us", "category_codes_missing", "category_codes_ranged", "amount_percentile_ranged",
             "is_high_amount_ranged", "amount_stats_by_class_ranged", "basic_stats_ranged", "roc_auc_ranged",
             "union_sources", "fraud_by_amount", "fraud_amount_range", "iqr_outliers_amount",
             "standardize_label_numeric", "score_model", "scan_csv_quoted", "scan_csv_rejects", "union_sources_types",
             "preview_file_order", "row_numbers", "fraud_head_file_order", "high_risk_file_order",
             "top_fraud_location_first_seen", "top_fraud_merchant_first_seen"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"create view {t} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("key", FAST_KEYS)
def test_matches_oracle(spark, con, key):
    sdf = entry.queries()[key](spark, SF_SMALL).toPandas()
    odf = con.sql(entry.oracle_sql()[key]).df()
    assert sorted(sdf.columns) == sorted(odf.columns)
    assert len(sdf) == len(odf)
    assert digest(sdf)[0] == digest(odf)[0]


def test_every_oracle_key_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["total_transactions"] > 0
