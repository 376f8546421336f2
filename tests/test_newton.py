"""Logistic regression by Newton steps: the optimum, few passes, collinear columns."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fraudframe.plans import ml, newton
from fraudframe.plans.catalog import processed
from fraudframe.plans.newton import _sums, fit_logistic

from .conftest import SF_SMALL


def vectors(spark, x, y, w):
    names = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(*map(float, r), float(a), float(b)) for r, a, b in zip(x, y, w)], [*names, "label", "weight"])
    return VectorAssembler(inputCols=names, outputCol="features").transform(df.repartition(5)), names


def sample(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x = np.column_stack([x, x[:, 0] + x[:, 1], np.zeros(n), x[:, 2] * 1000])  # a sum, a constant and a wide column
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n) > 0.8).astype(float)
    return x, y, np.where(y == 1, 2.5, 0.7)


def test_sums_equal_plain_numpy(spark):
    x, y, w = sample()
    vec, _ = vectors(spark, x, y, w)
    beta = np.array([0.1, 0.3, -0.2, 0.05, 0.0, 1.0, -0.001])
    rows = vec.select(vector_to_array("features").alias("x"), F.col("label").alias("y"), F.col("weight").alias("w"))
    total, loss, gradient, hessian = _sums(rows, beta)
    z = np.column_stack([np.ones(len(x)), x])
    p = 1 / (1 + np.exp(-z @ beta))
    assert total == pytest.approx(w.sum())
    assert loss == pytest.approx(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
    assert np.allclose(gradient, z.T @ (w * (p - y))) and np.allclose(hessian, z.T @ (z * (w * p * (1 - p))[:, None]))


def test_same_optimum_as_the_quasi_newton_optimiser(spark):
    x, y, w = sample()
    x = x[:, :4]
    vec, names = vectors(spark, x, y, w)
    fit = fit_logistic(vec, 1.0)
    other = LogisticRegression(maxIter=2000, tol=1e-13, elasticNetParam=0.0, standardization=False, weightCol="weight",
                               regParam=1.0 / w.sum()).fit(vec)
    assert fit.passes < 10 and fit.gradient < 1e-8
    assert np.allclose(fit.weights, [other.intercept, *other.coefficients], atol=1e-5)
    stages = fit.stages(names)
    scored = vec
    for s in stages:
        scored = s.transform(scored)
    mine = [(r["p"][1], r["prediction"]) for r in scored.orderBy("x0").select(vector_to_array("probability").alias("p"), "prediction").collect()]
    theirs = [(r["p"][1], r["prediction"]) for r in other.transform(vec).orderBy("x0").select(
        vector_to_array("probability").alias("p"), "prediction").collect()]
    assert np.allclose(mine, theirs, atol=1e-5)


def test_collinear_separable_and_constant(spark):
    x, y, w = sample()
    fit = fit_logistic(vectors(spark, x, y, w)[0])
    assert fit.gradient < 1e-8 and fit.passes < 20
    apart = np.array([[float(i)] for i in range(40)])
    fit = fit_logistic(vectors(spark, apart * 100, (apart[:, 0] > 20).astype(float), np.ones(40))[0])
    assert fit.gradient < 1e-6 and fit.weights[1] > 0  # the penalty keeps it finite


def test_training_ends_at_the_optimum(spark):
    df = processed(spark, SF_SMALL, "fx1")
    model, metrics = ml.train_model(df, "logistic_regression", cross_validation=False)
    data = ml.prepare(df, model.spec)
    train, _ = ml.stratified_split(data, 0.2, 42)
    assert metrics["gradient"] < 1e-8 and ml.penalised_gradient(model, train) < 1e-8


def test_a_pass_is_one_job_without_shuffle(spark):
    """Blocks of rows stay with the executors: a pass more is a job of one stage more."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(6000, 3)), (rng.random(6000) < 0.3).astype(float)
    rows = spark.createDataFrame([(r.tolist(), float(a), 1.0) for r, a in zip(x, y)], "x array<double>, y double, w double").repartition(3)
    blocks = newton._blocks(rows, 4).persist()
    assert sum(blocks.map(lambda b: len(b[1])).collect()) == 6000
    spark.sparkContext.setJobGroup("newton-pass", "")
    total, loss, gradient, hessian = newton._sums(blocks, np.zeros(4))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("newton-pass")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    full = np.column_stack([np.ones(6000), x])
    assert len(jobs) == 1 and total == 6000 and loss == pytest.approx(6000 * np.log(2))
    assert np.allclose(gradient, full.T @ (0.5 - y)) and np.allclose(hessian, full.T @ full / 4)
    blocks.unpersist()
