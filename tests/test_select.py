"""Radix selection against sorting, and the plans of splits and quantiles."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudframe.operators import profile, quality, select
from fraudframe.operators.ranks import quantile_table
from fraudframe.plans import ml


def odd_doubles():
    rng = random.Random(1)
    out = [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, math.inf, -math.inf, 7.5]
    out += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    out += [s * np.nextafter(2.0 ** k, t) for k in range(-1070, 1020, 7) for s in (1, -1) for t in (0, 4.0 ** 500)]
    return [float(v) for v in out if v == v]


def test_double_key_keeps_the_order(spark):
    df = spark.createDataFrame([(v,) for v in odd_doubles()], "x double")
    rows = sorted((r["x"], r["k"]) for r in df.select("x", select.double_key(F.col("x")).alias("k")).collect())
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))
    assert all(a[1] < b[1] for a, b in zip(rows, rows[1:]) if abs(a[0] - b[0]) > 1e-9 * abs(b[0]) and math.isfinite(a[0] - b[0]))


@pytest.mark.parametrize("few", [0, 3, 20_000])
def test_ranks_equal_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(select, "FEW", few)
    values = [(v, i % 3) for i, v in enumerate(odd_doubles())] + [(7.5, 0)] * 500 + [(None, 0), (1.0, None)]
    df = spark.createDataFrame(values, "x double, g int").repartition(4)
    got = select.select_ranks(df, F.col("x"), select.double_key(F.col("x")), lambda g, n: [0, 1, n // 3, n - 1, n], F.col("g"))
    for g in (0, 1, 2, None):
        own = sorted(v for v, h in values if h == g and v is not None)
        n = len(own)
        assert got[g] == (n, {k: own[k] for k in {0, 1, n // 3, n - 1} if k < n})


@pytest.mark.parametrize("kind", ["int", "bigint", "date", "timestamp", "decimal(20,3)", "float", "boolean"])
def test_ranks_of_other_types(spark, kind):
    base = spark.range(-300, 300)
    value = {"date": "date_add(date'1970-01-01', cast(id * 37 as int))", "timestamp": "timestamp_micros(id * 86400000123)",
             "boolean": "id > 100"}.get(kind, f"cast(id * 7919 % 1000 as {kind})")
    df = base.select(F.expr(value).alias("x"))
    want = sorted(r["x"] for r in df.collect())
    got = select.select_ranks(df, F.col("x"), select.ordered_key(F.col("x"), df.schema["x"].dataType), lambda g, n: range(0, n, 7))
    assert got[0][1] == {k: want[k] for k in range(0, 600, 7)}
    with pytest.raises(TypeError):
        select.ordered_key(F.col("x"), T.BinaryType())


def test_quantiles_equal_numpy_on_both_paths(spark):
    rng = np.random.default_rng(2)
    x = np.where(rng.random(5000) < 0.3, 7.5, np.round(rng.lognormal(3, 2, 5000), 2) * rng.choice([1, -1], 5000))
    df = spark.createDataFrame([(float(v), int(i % 2)) for i, v in enumerate(x)], "amount double, is_fraud int")
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    for path in ("bounded", "ranged"):
        rows = {r["is_fraud"]: [r[f"q{i}"] for i in range(6)] for r in quantile_table(
            df, "amount", probs, [f"q{i}" for i in range(6)], ["is_fraud"], path).collect()}
        for g in (0, 1):
            assert np.allclose(rows[g], np.quantile(x[np.arange(5000) % 2 == g], probs), rtol=1e-12)
    empty = quantile_table(df.limit(0), "amount", [0.5], ["m"], path="ranged").collect()
    assert [r["m"] for r in empty] == [None]
    for f in (profile.amount_stats_by_class, lambda d, path: quality.basic_stats(d, "amount", path), quality.iqr_outliers):
        assert f(df, path="ranged").collect() == f(df, path="bounded").collect()


def test_no_unique_key_is_shuffled_and_nothing_is_written(spark, monkeypatch):
    """What the passes exchange are counters per leading digits, a sixth column never."""
    plans = []
    collect = type(spark.range(0)).collect

    def watched(self):
        plans.append(self._jdf.queryExecution().optimizedPlan().toString())
        return collect(self)
    monkeypatch.setattr(type(spark.range(0)), "collect", watched)
    monkeypatch.setattr(ml, "materialize", lambda *a: pytest.fail("a split writes nothing"))
    df = spark.range(200_000).select(F.col("id").alias("transaction_id"), (F.col("id") % 9 == 0).cast("double").alias("label"))
    train, test = ml.stratified_split(df, 0.2, 42)
    folds = df.withColumn("fold", ml.fold_column(df, 5, 42)).groupBy("label", "fold").count()
    monkeypatch.undo()
    assert 4 <= len(plans) <= 6
    first = [p for p in plans if "_k" not in p.split("Aggregate")[1].split("\n")[0].split("[")[1]]
    assert len(first) >= 2 and all("shiftright" in p for p in plans)
    assert test.count() == round(0.2 * 22223) + round(0.2 * 177777) and train.count() + test.count() == 200_000
    assert {(r["label"], r["count"] - n // 5) for r in folds.collect() for n in [22223 if r["label"] else 177777]} <= {
        (1.0, 0), (1.0, 1), (0.0, 0), (0.0, 1)}
