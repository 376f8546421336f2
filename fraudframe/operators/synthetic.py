"""Seeded synthetic transaction tables, generated as one narrow Spark job.

Rows come from ``spark.range(n)`` (or any dense 0..n-1 id column); every
random draw is a pure function of (seed, draw number, row id) through
``xxhash64``, so the table is identical whatever the partitioning and a lost
task recomputes exactly the same rows.  No shuffle, no per-row Python.

Rules: the first n - int(n * fraud_ratio) ids are legitimate, the rest
fraud.  Legitimate amounts are normal around the middle of the range and
clipped; fraud amounts are the range maximum (anomaly), a round amount, or
uniform.  Fraud happens more at night and shifts Friday to Saturday;
fraud prefers high-risk merchants and foreign locations when anomalies are
on.  Optional correlated columns (velocity, distance, account age, failed
attempts, merchant risk), 1% noise on the amount and ~1% missing card type
and location.  ``seasonal_patterns`` is accepted and, as in the reference,
has no effect.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S

_MASK53 = (1 << 53) - 1


class _Draws:
    """Uniform / normal / choice draws keyed by (seed, draw number, id)."""

    def __init__(self, seed: int, id_col: str = "id"):
        self.seed = seed
        self.id = F.col(id_col)
        self.k = 0

    def uniform(self) -> Column:
        self.k += 1
        h = F.xxhash64(F.lit(self.seed), F.lit(self.k), self.id)
        return (F.shiftright(h, 11).bitwiseAND(F.lit(_MASK53)).cast("double") + 0.5) / float(1 << 53)

    def normal(self, mean: float = 0.0, std: float = 1.0) -> Column:
        u1, u2 = self.uniform(), self.uniform()
        z = F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * math.pi * u2)
        return F.lit(mean) + F.lit(std) * z

    def randint(self, lo: int, hi: int) -> Column:
        """Integer in [lo, hi] inclusive."""
        return (F.lit(lo) + F.floor(self.uniform() * (hi - lo + 1))).cast("int")

    def choice(self, values: list) -> Column:
        arr = F.array(*[F.lit(v) for v in values])
        return F.element_at(arr, self.randint(1, len(values)))

    def exponential(self, mean: float) -> Column:
        return -mean * F.log1p(-self.uniform())

    def poisson(self, lam: float) -> Column:
        """Inverse-CDF Poisson: the first k whose CDF reaches u (tail below 1e-15 dropped)."""
        u = self.uniform()
        p = math.exp(-lam)
        cdf, k, expr_terms = p, 0, []
        while cdf < 1 - 1e-15 and k < 200:
            expr_terms.append((cdf, k))
            k += 1
            p *= lam / k
            cdf += p
        expr = F.lit(k)
        for c, kk in reversed(expr_terms):
            expr = F.when(u <= c, F.lit(kk)).otherwise(expr)
        return expr.cast("long")


def generate_from_ids(ids: DataFrame, n: int, fraud_ratio: float = 0.1,
                      dataset_type: str = "credit_card", amount_range: tuple = (10, 5000),
                      include_anomalies: bool = True, seasonal_patterns: bool = True,
                      correlation_features: bool = True, seed: int = 42,
                      base_time: dt.datetime | None = None) -> DataFrame:
    """Synthetic transactions for the dense ids 0..n-1 in column ``id`` of ``ids``."""
    if dataset_type not in S.MERCHANTS_BY_TYPE and dataset_type != "mixed":
        raise ValueError(f"Unknown dataset type: {dataset_type}")
    lo, hi = float(amount_range[0]), float(amount_range[1])
    n_fraud = int(n * fraud_ratio)
    n_legit = n - n_fraud
    base = base_time or dt.datetime.now().replace(microsecond=0)
    merchants = S.MERCHANTS_BY_TYPE.get(dataset_type, S.MERCHANTS_BY_TYPE["credit_card"])
    high_risk = [m for m in merchants if m in S.HIGH_RISK_MERCHANTS]
    d = _Draws(seed)
    fraud = F.col("id") >= n_legit
    anomalies = F.lit(bool(include_anomalies))

    legit_amount = F.greatest(F.lit(lo), F.least(F.lit(hi), d.normal((lo + hi) / 2, (hi - lo) / 6)))
    # hi * U(3, 10) / 3 is never below hi, so the anomaly amount is the maximum.
    fraud_amount = (F.when(anomalies & (d.uniform() < 0.4), F.lit(hi))
                    .when(d.uniform() < 0.6, d.choice(S.ROUND_FRAUD_AMOUNTS))
                    .otherwise(F.lit(lo) + (hi - lo) * d.uniform()))
    amount = F.when(fraud, fraud_amount).otherwise(legit_amount)

    start = F.to_date(F.lit(base.date().isoformat()))
    day = F.date_add(start, d.randint(0, 180) - 180)
    shift = fraud & (d.uniform() < 0.7) & (F.pmod(5 - F.weekday(day), F.lit(7)) < 2)
    day = F.when(shift, F.date_add(day, F.pmod(5 - F.weekday(day), F.lit(7)).cast("int"))).otherwise(day)
    fraud_hour = F.when(d.uniform() < 0.4, d.choice(S.NIGHT_HOURS)).otherwise(d.randint(0, 23))
    legit_hour = F.when(d.uniform() < 0.7, d.randint(9, 17)).otherwise(d.randint(6, 22))
    hour = F.when(fraud, fraud_hour).otherwise(legit_hour)
    secs = hour * 3600 + d.randint(0, 59) * 60 + d.randint(0, 59)
    ts = F.timestamp_add("SECOND", secs, day.cast("timestamp_ntz"))

    fraud_merchant = (F.when(anomalies & (d.uniform() < 0.6), d.choice(high_risk or merchants))
                      .otherwise(d.choice(merchants)))
    merchant = F.when(fraud, fraud_merchant).otherwise(d.choice(merchants))
    fraud_location = (F.when(anomalies & (d.uniform() < 0.3), d.choice(S.FOREIGN_LOCATIONS))
                      .otherwise(d.choice(S.LOCATIONS)))
    location = F.when(fraud, fraud_location).otherwise(d.choice(S.LOCATIONS))
    user = F.format_string("USER_%d", d.randint(1000, 9998))
    txn = F.when(fraud, F.format_string("FRAUD_%06d", F.col("id") - n_legit)).otherwise(
        F.format_string("TXN_%06d", F.col("id")))

    noisy = F.abs(F.bround(amount * (1 + d.normal(0.0, 0.01)), 2))
    picked = d.uniform() < 0.02
    cols = {"amount": noisy, "timestamp": ts, "merchant_category": merchant,
            "location": F.when(picked & (d.uniform() < 0.5), F.lit(None).cast("string")).otherwise(location)}
    if dataset_type in S.CARD_DATASET_TYPES:
        cols["card_type"] = F.when(picked & (d.uniform() < 0.5), F.lit(None).cast("string")).otherwise(
            d.choice(S.CARD_TYPES))
    cols["user_id"] = user
    cols["is_fraud"] = fraud.cast("int")
    cols["transaction_id"] = txn
    if correlation_features:
        risk = F.create_map(*[x for k, v in S.MERCHANT_RISK.items() for x in (F.lit(k), F.lit(v))])
        cols["transactions_last_hour"] = F.when(fraud, d.poisson(8)).otherwise(d.poisson(2))
        cols["distance_from_home"] = F.when(fraud, d.exponential(200)).otherwise(d.exponential(50))
        cols["account_age_days"] = F.when(fraud, d.exponential(180)).otherwise(d.exponential(365))
        cols["failed_attempts_last_day"] = F.when(fraud, d.poisson(3)).otherwise(d.poisson(0.5))
        cols["merchant_risk_score"] = F.coalesce(F.element_at(risk, F.col("merchant_category")),
                                                 F.lit(S.DEFAULT_MERCHANT_RISK))
    out = ids.select("id").where((F.col("id") >= 0) & (F.col("id") < n))
    # Generation is CPU-heavy per row: an id source with fewer partitions than
    # cores (one small file) is spread first; a wide source is left as it is.
    cores = ids.sparkSession.sparkContext.defaultParallelism
    if out.rdd.getNumPartitions() < cores:
        out = out.repartition(cores)
    out = out.select("id", *[v.alias(k) for k, v in cols.items() if k != "merchant_risk_score"])
    if correlation_features:
        out = out.withColumn("merchant_risk_score", cols["merchant_risk_score"])
    return out.drop("id")


def generate_fraud_data(spark: SparkSession, num_samples: int = 1000, fraud_ratio: float = 0.1,
                        dataset_type: str = "credit_card", amount_range: tuple = (10, 5000),
                        include_anomalies: bool = True, seasonal_patterns: bool = True,
                        correlation_features: bool = True, seed: int = 42,
                        base_time: dt.datetime | None = None,
                        partitions: int | None = None) -> DataFrame:
    """A synthetic table of ``num_samples`` rows (see module docstring)."""
    ids = spark.range(0, num_samples, 1, partitions) if partitions else spark.range(num_samples)
    return generate_from_ids(ids, num_samples, fraud_ratio, dataset_type, amount_range,
                             include_anomalies, seasonal_patterns, correlation_features, seed,
                             base_time)


def synthetic_summary(df: DataFrame) -> DataFrame:
    """Rows, fraud rows and the actual fraud ratio (3 dp)."""
    a = df.agg(F.count(F.lit(1)).alias("total_samples"),
               F.coalesce(F.sum("is_fraud"), F.lit(0)).cast("long").alias("fraud_samples"))
    return a.withColumn("actual_fraud_ratio",
                        F.round(F.col("fraud_samples") / F.col("total_samples"), 3))


def seeded_shuffle(df: DataFrame, seed: int = 42) -> DataFrame:
    """A reproducible full shuffle of the rows (order by a seeded row hash).

    Row order carries no meaning in a table; this exists for callers that
    want the reference's shuffled output order, at the cost of a range sort.
    """
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]))
