"""Hand-made inputs for the rules where pandas and Spark differ."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudframe.functions import scalar as X
from fraudframe.operators import charts, features, ranks


@pytest.fixture(params=["small", "ranged"])
def rank_path(request, monkeypatch):
    if request.param == "ranged":
        monkeypatch.setattr(ranks, "SMALL_DISTINCT", 0)
    return request.param


def test_average_rank_percentile(spark, rank_path):
    vals = [1, 2, 2, 5, 9, 9, 9, 10]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    st = ranks.order_statistics(df, "x", partitions=3)
    got = {r["value"]: r["pct"] for r in ranks.average_rank_pct(st).collect()}
    assert [got[float(v)] for v in vals] == [.125, .3125, .3125, .5, .75, .75, .75, 1.0]


def test_exact_quantiles_match_numpy(spark, rank_path):
    import numpy as np
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0, 5.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    st = ranks.order_statistics(df, "x", partitions=4)
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = ranks.quantile_values(st, probs)
    assert got == pytest.approx(list(np.quantile(vals, probs)))


def test_grouped_quantiles(spark, rank_path):
    import numpy as np
    rows = [(g, float(v)) for g in (0, 1) for v in range(g * 7, g * 7 + 10 + g * 3)]
    df = spark.createDataFrame(rows, "g int, x double")
    st = ranks.order_statistics(df, "x", groups=["g"], partitions=3)
    got = {r["g"]: r["q0"] for r in ranks.quantiles(st, [0.5]).collect()}
    for g in (0, 1):
        assert got[g] == pytest.approx(np.median([v for gg, v in rows if gg == g]))


def test_category_codes_and_frequency(spark, rank_path):
    vals = ["b", "a", None, "c", "a", "Z", "é", "b"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, location string")
    out = features.category_features(df, ["location"]).orderBy("i").collect()
    assert [r["location_encoded"] for r in out] == [2, 1, -1, 3, 1, 0, 4, 2]
    assert [r["location_frequency"] for r in out] == [2, 2, None, 1, 2, 1, 1, 2]


def test_pairwise_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 1.0, 7.0), (3.0, None, 7.0),
                                (None, 4.0, 7.0), (5.0, 7.0, 7.0)], "x double, y double, c double")
    r = {(a["x"], a["y"]): a["r"] for a in charts.correlation_matrix(df).collect()}
    assert r[("x", "y")] == pytest.approx(0.9215506405654281)
    assert r[("y", "x")] == pytest.approx(0.9215506405654281)
    assert r[("x", "x")] == 1.0
    assert r[("x", "c")] is None and r[("c", "c")] is None


def test_headline_rounds_halves_to_even(spark):
    from fraudframe.operators import profile
    df = spark.createDataFrame([(0.125, 1)] + [(1.0, 0)] * 7, "amount double, is_fraud int")
    r = profile.headline_metrics(df).first()
    assert r["avg_fraud_amount"] == 0.12 and r["fraud_rate"] == 12.5


def test_correlation_of_many_columns_in_one_pass(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 200)) * rng.choice([1e-3, 1, 1e4], 200) + rng.choice([0, 1e3, -1e5], 200)
    x[:, 7] = x[:, 3] * 2 + 5
    x[:, 9] = 42.1
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 11] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(200)])
    df = spark.createDataFrame(pdf).repartition(130)  # two groups of tasks and a rest
    out = charts.correlation_matrix(df).toPandas().pivot(index="x", columns="y", values="r").loc[pdf.columns, pdf.columns].to_numpy(float)
    want = pdf.corr().to_numpy()
    want[[9, 11]], want[:, [9, 11]] = np.nan, np.nan  # no r with a constant or an empty side
    assert np.allclose(out, want, atol=2e-6, equal_nan=True) and out[3, 7] == pytest.approx(1.0)


def test_integer_epochs_are_exact(spark):
    df = spark.createDataFrame([(1_700_000_000_123_456_789,), (-1,)], "t long")
    got = [r[0] for r in df.select(X.parse_timestamp(F.col("t"), T.LongType())).collect()]
    assert got == [dt.datetime(2023, 11, 14, 22, 13, 20, 123456), dt.datetime(1969, 12, 31, 23, 59, 59, 999999)]


def test_failed_timestamp_is_no_feature(spark):
    from fraudframe.plans import flows
    rows = [(float(i), i % 2, "2024-01-02" if i != 15 else "soon") for i in range(20)]
    raw = spark.createDataFrame(rows, "amount double, is_fraud int, date string")
    assert "date" not in flows.analyse(raw)["processed"].columns


def test_integer_label_with_nulls_takes_numeric_fallback(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, None), (3.0, 0)], "amount double, fraud_label long")
    facts = features.collect_facts(df)
    assert facts.label_mode == "numeric"
    out = features.standardize_label(df, facts.label_mode).orderBy("amount").collect()
    assert [r["is_fraud"] for r in out] == [1, 0, 0]


def test_integer_label_without_nulls_drops_unmapped(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (3.0, 0)], "amount double, fraud_label long")
    facts = features.collect_facts(df)
    assert facts.label_mode == "map"
    out = features.standardize_label(df, facts.label_mode).orderBy("amount").collect()
    assert [r["is_fraud"] for r in out] == [1, 0]


def test_amount_text_rules(spark):
    texts = ["$1", "1,000", "0x1A", "1.5d", "1f", "", "NaN", " 12 ", "1e3", "-4.5", ".5", "inf"]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    got = [r[0] for r in df.select(X.to_number(F.col("a"), T.StringType())).collect()]
    assert got[:7] == [None] * 7
    assert got[7:11] == [12.0, 1000.0, -4.5, 0.5]
    assert got[11] == float("inf")


def test_weekday_is_monday_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7, 10), ), (dt.datetime(2024, 1, 8, 23),)],
                               "ts timestamp_ntz")
    df = df.withColumn("amount", F.lit(1.0)).withColumn("fraud_label", F.lit("yes"))
    df = df.withColumnRenamed("ts", "timestamp")
    out = features.time_features(df, drop=False).orderBy("timestamp").collect()
    assert [r["day_of_week"] for r in out] == [6, 0]
    assert [r["is_weekend"] for r in out] == [True, False]


def test_bad_timestamp_drops_column(spark):
    df = spark.createDataFrame([(1.0, "yes", "2024-01-02"), (2.0, "no", "01/02/2024")],
                               "amount double, fraud_label string, timestamp string")
    out = features.build_features(df, {})
    assert "timestamp" not in out.columns and "hour" not in out.columns


def test_readable_sample_and_case_guard(spark, tmp_path):
    from fraudframe.sources import ingest
    good = tmp_path / "good.csv"
    good.write_text("amount,label\n1.5,yes\nNA,no\n")
    ok, _ = ingest.readable_sample(spark, str(good))
    assert ok
    df = ingest.scan_csv(spark, str(good))
    assert df.where("amount is null").count() == 1      # 'NA' is missing, as in pandas
    one = tmp_path / "one.csv"
    one.write_text("amount\n1\n")
    assert not ingest.readable_sample(spark, str(one))[0]
    dup = spark.createDataFrame([(1, 2)], "Amount int, amount int")
    with pytest.raises(ValueError):
        ingest.check_column_names(dup)


def test_seeded_shuffle_is_reproducible(spark):
    from fraudframe.operators import synthetic
    df = spark.range(200).withColumn("v", F.col("id") * 3)
    a = [r["id"] for r in synthetic.seeded_shuffle(df, 7).collect()]
    b = [r["id"] for r in synthetic.seeded_shuffle(df.repartition(5), 7).collect()]
    assert a == b and sorted(a) == list(range(200)) and a != list(range(200))
