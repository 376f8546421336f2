"""Forms of text times inferred from whole columns, against values written from known moments."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudframe.functions import scalar as X
from fraudframe.functions import timeformat
from fraudframe.operators import detect, features
from fraudframe.session import scratch_path
from fraudframe.streaming import scoring

MOMENTS = [datetime(2024, m, d, h, mi, s) for m, d, h, mi, s in [
    (1, 2, 0, 5, 9), (2, 3, 11, 59, 0), (3, 14, 12, 0, 1), (12, 31, 23, 59, 59), (7, 8, 13, 30, 30), (10, 11, 1, 2, 3)]]


def hour12(t):
    return f"{t.hour % 12 or 12}:{t.minute:02}"


WRITTEN = {
    "us": lambda t: t.strftime("%m/%d/%Y %H:%M:%S"),
    "us, no zeros": lambda t: f"{t.month}/{t.day}/{t.year} {t.hour}:{t.minute:02}:{t.second:02}",
    "day first": lambda t: t.strftime("%d/%m/%Y %H:%M:%S"),
    "two-digit year": lambda t: t.strftime("%m/%d/%y %H:%M:%S"),
    "dots": lambda t: t.strftime("%d.%m.%Y %H:%M:%S"),
    "month name": lambda t: t.strftime("%d-%b-%Y %H:%M:%S"),
    "month name, two-digit year": lambda t: t.strftime("%d-%b-%y %H:%M:%S").upper(),
    "long name": lambda t: t.strftime("%B %d, %Y %H:%M:%S"),
    "weekday and zone": lambda t: t.strftime("%a, %d %b %Y %H:%M:%S +0200"),
    "zone name": lambda t: t.strftime("%Y/%m/%d %H:%M:%S UTC"),
    "iso zone": lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ"),
    "iso": lambda t: t.strftime("%Y-%m-%d %H:%M:%S"),
    "fraction": lambda t: t.strftime("%d.%m.%Y %H:%M:%S.250"),
    "half of the day": lambda t: t.strftime("%m/%d/%Y ") + hour12(t) + t.strftime(":%S %p"),
    "half, lower and close": lambda t: t.strftime("%b %d, %Y ") + hour12(t) + t.strftime(":%S%p").lower(),
    "compact": lambda t: t.strftime("%Y%m%d %H:%M:%S"),
}


@pytest.mark.parametrize("name", WRITTEN)
def test_whole_columns_of_one_form(spark, name):
    df = spark.createDataFrame([(i, WRITTEN[name](t)) for i, t in enumerate(MOMENTS)] + [(99, None)], "i int, t string")
    best = None
    for form in timeformat.candidates(df, "t"):
        got = {r["i"]: r["ts"] for r in df.select("i", X.parse_timestamp(F.col("t"), T.StringType(), form).alias("ts")).collect()}
        if best is None or sum(v is not None for v in got.values()) > sum(v is not None for v in best.values()):
            best = got
    want = {i: t.replace(microsecond=250_000 if name == "fraction" else 0) for i, t in enumerate(MOMENTS)}
    assert best == want | {99: None}


def test_a_part_above_twelve_decides(spark):
    ranges = {"n/n/Y": ([12, 31, 2024], ["M/d/yyyy"]), "n-n-Y": ([31, 12, 2024], ["d-M-yyyy"])}
    for found, (largest, forms) in ranges.items():
        assert timeformat.forms_of(found, largest) == forms
    assert timeformat.forms_of("n/n/Y n:n", [12, 12, 2024]) == ["M/d/yyyy H:m", "d/M/yyyy H:m"]
    assert timeformat.forms_of("n/n/n", [99, 12, 31]) == ["yy/M/d"]
    assert timeformat.forms_of("nonsense", [None] * 3) == [] == timeformat.forms_of("Y-n-n at n", [2024, 1, 2])


def test_two_digit_years_turn_at_69(spark):
    df = spark.createDataFrame([("1/2/68",), ("1/2/69",), ("1/2/99",), ("1/2/00",)], "t string")
    assert [r[0].year for r in df.select(timeformat.parse(F.col("t"), "M/d/yy")).collect()] == [2068, 1969, 1999, 2000]


def raw(spark, written, bad=None):
    rows = [(i, 10.0 + i, "fraud" if i % 3 == 0 else "legitimate", bad if bad and i == 7 else written(MOMENTS[i % 6])) for i in range(60)]
    return spark.createDataFrame(rows, "transaction_id long, amount double, is_fraud string, date string")


@pytest.mark.parametrize("name", ["month name, two-digit year", "half of the day", "weekday and zone", "day first"])
def test_tables_with_such_times_are_detected_and_built(spark, name):
    df = raw(spark, WRITTEN[name])
    mapping = detect.detect_columns(df)
    assert mapping["timestamp"] == "date"
    out = features.build_features(df, mapping, want=[])
    assert {r["transaction_id"]: r["hour"] for r in out.collect()} == {i: MOMENTS[i % 6].hour for i in range(60)}


def test_one_bad_value_drops_the_column(spark):
    df = raw(spark, WRITTEN["month name"], bad="soon")
    assert not detect.detect_columns(df).get("timestamp")
    mapping = {"amount": "amount", "fraud_label": "is_fraud", "timestamp": "date"}
    assert "timestamp" not in features.build_features(df, mapping, want=[]).columns
    kept = features.build_features(df, mapping, on_bad_timestamp="coerce", want=[])
    assert kept.where("timestamp is null").count() == 1


def test_stream_reads_times_by_the_form_of_the_snapshot(spark):
    df = raw(spark, WRITTEN["us"])
    mapping = {"amount": "amount", "fraud_label": "is_fraud", "timestamp": "date"}
    table, facts = features.build_features(df, mapping, return_facts=True)
    snap = scoring.fit_snapshot(table, scratch_path(spark, "snapshot"), facts.timestamp_format)
    out = scoring.stream_features(df, mapping, snap)
    assert {r["transaction_id"]: r["hour"] for r in out.collect()} == {i: MOMENTS[i % 6].hour for i in range(60)}
