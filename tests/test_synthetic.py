"""Generator: exact counts, partition-independence, distribution moments."""

import datetime as dt

from pyspark.sql import functions as F

from fraudframe.operators import synthetic

BASE = dt.datetime(2024, 2, 1)


def test_counts_and_ids(spark):
    df = synthetic.generate_fraud_data(spark, 5000, 0.13, base_time=BASE)
    s = synthetic.synthetic_summary(df).first()
    assert s["total_samples"] == 5000 and s["fraud_samples"] == int(5000 * 0.13)
    ids = df.agg(F.count_distinct("transaction_id")).first()[0]
    assert ids == 5000
    assert df.where(F.col("transaction_id").startswith("FRAUD_")).count() == 650


def test_same_table_whatever_the_partitioning(spark):
    a = synthetic.generate_fraud_data(spark, 3000, base_time=BASE, partitions=2)
    b = synthetic.generate_fraud_data(spark, 3000, base_time=BASE, partitions=7)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_moments(spark):
    n = 20000
    pdf = synthetic.generate_fraud_data(spark, n, 0.2, base_time=BASE).toPandas()
    legit, fraud = pdf[pdf.is_fraud == 0], pdf[pdf.is_fraud == 1]
    assert abs(legit.transactions_last_hour.mean() - 2) < 5 * (2 / len(legit)) ** 0.5
    assert abs(fraud.transactions_last_hour.mean() - 8) < 5 * (8 / len(fraud)) ** 0.5
    assert abs(legit.distance_from_home.mean() - 50) < 5 * 50 / len(legit) ** 0.5
    assert abs(fraud.account_age_days.mean() - 180) < 5 * 180 / len(fraud) ** 0.5
    # clipped to the range, then 1% multiplicative noise
    assert legit.amount.between(10 * 0.94, 5000 * 1.06).all()
    # Only Friday moves (to Saturday): fraud Fridays are rarer than legit ones.
    wd_f = fraud.timestamp.dt.weekday.value_counts(normalize=True)
    wd_l = legit.timestamp.dt.weekday.value_counts(normalize=True)
    assert wd_f.get(4, 0) < 0.6 * wd_l[4] and wd_f[5] > wd_l[5]
    # ~1% missing per optional column
    assert 0.003 < pdf.location.isna().mean() < 0.02


def test_mobile_money_has_no_card_type(spark):
    df = synthetic.generate_fraud_data(spark, 100, dataset_type="mobile_money", base_time=BASE)
    assert "card_type" not in df.columns


def test_fraud_amount_mix(spark):
    pdf = synthetic.generate_fraud_data(spark, 20000, 0.25, base_time=BASE,
                                        correlation_features=False).toPandas()
    fraud = pdf[pdf.is_fraud == 1].amount
    # 40% anomalies sit at the range maximum (then 1% noise); 60% of the rest are round amounts.
    near_max = fraud.between(5000 * 0.95, 5000 * 1.05).mean()
    assert 0.35 < near_max < 0.5
    rounds = [100, 200, 500, 1000, 1500, 2000]
    near_round = sum(fraud.between(r * 0.95, r * 1.05).mean() for r in rounds)
    assert 0.3 < near_round < 0.45
    assert "transactions_last_hour" not in pdf.columns
