"""Second-order boosting against a hand computation, a plain version and the engine's own boosted trees; model versions; folds."""

import math
import time

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from fraudframe.operators import evaluate
from fraudframe.plans import blocks, boosting, ml
from fraudframe.plans.catalog import processed
from fraudframe.session import scratch_path

from .conftest import SF_CHECK, SF_SMALL


def table(spark, x, y, w):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(*map(float, r), float(a), float(b)) for r, a, b in zip(x, y, w)]
    return spark.createDataFrame(rows, [*names, "label", "weight"]).repartition(4), names


def test_first_tree_by_hand(spark):
    """x <= 2: two negatives and a positive; x > 2: three positives.  g = p - y = +-1/2, h = 1/4 at the start."""
    x, y = np.array([[1.0], [2.0], [2.0], [3.0], [4.0], [5.0]]) , np.array([0, 0, 1, 1, 1, 1])
    df, names = table(spark, x, y, np.ones(6))
    old = boosting.MIN_CHILD
    boosting.MIN_CHILD = 0.5
    try:
        model = boosting.fit_booster(df, names, rounds=1, depth=1)
    finally:
        boosting.MIN_CHILD = old
    tree = model.trees[0]
    # Left: G = 1/2 + 1/2 - 1/2, H = 3/4; right: G = -3/2, H = 3/4; leaves -0.1 G / (H + 1).
    assert (tree.feature, tree.cut[0]) == ([0, -1, -1], 2.0)
    assert tree.value[1:] == pytest.approx([-0.1 * 0.5 / 1.75, 0.1 * 1.5 / 1.75])
    g, h = np.array([0.5, 0.0, -0.5, -0.5, -0.5]), np.array([0.25, 0.5, 0.25, 0.25, 0.25])
    assert boosting.best_split(g, h, np.array([0, 5])) is None  # no side weighs MIN_CHILD
    # The same sums four times over: GL = 2, HL = 3, GR = -6, HR = 3.
    gain, feature, bin_ = boosting.best_split(4 * g, 4 * h, np.array([0, 5]))
    assert (feature, bin_) == (0, 1) and gain == pytest.approx((2 ** 2 / 4 + 6 ** 2 / 4 - 4 ** 2 / 7) / 2)


def plain_boosting(x, y, w, rounds, depth):
    """Exact greedy splits over all distinct values, no bins, no Spark."""
    margin, trees = np.zeros(len(y)), []

    def grow(rows, level):
        p = 1 / (1 + np.exp(-margin[rows]))
        g, h = w[rows] * (p - y[rows]), w[rows] * p * (1 - p)
        leaf = -0.1 * g.sum() / (h.sum() + 1)
        best = None
        if level < depth:
            for f in range(x.shape[1]):
                for c in np.unique(x[rows, f])[:-1]:
                    left = x[rows, f] <= c
                    if h[left].sum() < 1 or h[~left].sum() < 1:
                        continue
                    gain = (g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)) / 2
                    if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = (gain, f, c, left)
        if best is None:
            return leaf
        _, f, c, left = best
        return f, c, grow(rows[left], level + 1), grow(rows[~left], level + 1)

    def value(tree, r):
        while isinstance(tree, tuple):
            tree = tree[2] if r[tree[0]] <= tree[1] else tree[3]
        return tree
    for _ in range(rounds):
        tree = grow(np.arange(len(y)), 0)
        trees.append(tree)
        margin = margin + np.array([value(tree, r) for r in x])
    return margin


def test_equals_plain_boosting_and_refreshes_its_margins(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.integers(0, 9, 300), rng.normal(size=300).round(1), rng.integers(0, 2, 300)]).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 0.3) ^ (rng.random(300) < 0.1)).astype(float)
    w = np.where(y == 1, 1.7, 1.0)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    df, names = table(spark, x, y, w)
    model = boosting.fit_booster(df, names, rounds=5, depth=3)
    assert np.allclose(model.margins(x), plain_boosting(x, y, w, 5, 3), atol=1e-9)
    again = boosting.Booster.from_dict(model.to_dict())
    assert np.array_equal(again.margins(x), model.margins(x))


def test_blocks_and_partial_sums_give_the_same_trees_in_one_job_a_level(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 9, 400), rng.normal(size=400).round(1)]).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 0.3)).astype(float)
    df, names = table(spark, x, y, np.ones(400))
    whole = boosting.fit_booster(df, names, rounds=4, depth=3)
    for name, value in (("BLOCK", 32), ("TASK_ROWS", 40), ("REFRESH", 100)):
        monkeypatch.setattr(boosting, name, value)
    monkeypatch.setattr(blocks, "DIRECT", 0)
    cut = boosting.fit_booster(df, names, rounds=4, depth=3)
    assert [t.feature for t in cut.trees] == [t.feature for t in whole.trees] and [t.cut for t in cut.trees] == [t.cut for t in whole.trees]
    assert np.allclose(cut.margins(x), plain_boosting(x, y, np.ones(400), 4, 3), atol=1e-9)
    jobs = {}
    for rounds in (2, 6):
        spark.sparkContext.setJobGroup(f"boost-{rounds}", "")
        boosting.fit_booster(df, names, rounds=rounds, depth=3)
        jobs[rounds] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boost-{rounds}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[6] - jobs[2] <= 4 * 3


def test_bins_carry_about_equal_weight(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([np.exp(rng.normal(0, 4, 20_000)), np.where(rng.random(20_000) < 0.4, 7.5, rng.normal(size=20_000)), np.zeros(20_000)])
    w = np.where(rng.random(20_000) < 0.1, 9.0, 1.0)
    df, names = table(spark, x, np.zeros(20_000), w)
    cuts = boosting.weighted_cuts(df, names, bins=64)
    assert cuts[2] == [0.0] and 7.5 in cuts[1] and all(n <= len(c) <= 64 for n, c in zip((50, 35), cuts))
    for i in (0, 1):
        assert cuts[i] == sorted(set(cuts[i])) and cuts[i][-1] == x[:, i].max()
        share = np.bincount(np.searchsorted(cuts[i], x[:, i]), w) / w.sum()
        assert np.delete(share, np.searchsorted(cuts[i], 7.5) if i else []).max() < 3 / 64


def test_auc_at_least_that_of_first_order_trees(spark):
    df = processed(spark, SF_CHECK, "fx1").select("transaction_id", "amount", "hour", "day_of_week", "location_frequency", "is_fraud")
    noisy = df.withColumn("is_fraud", F.when(F.xxhash64("transaction_id") % 10 == 0, 1 - F.col("is_fraud")).otherwise(F.col("is_fraud")))
    spec = ml.feature_spec(noisy)
    data = ml.prepare(noisy, spec).select("transaction_id", *spec.numeric, "label").withColumn("weight", F.lit(1.0)).persist()
    train, test = ml.stratified_split(data)
    mine = boosting.fit_booster(train, spec.numeric, rounds=10, depth=4)
    scored = test.withColumn("p", F.element_at(ml.vector_to_array(mine.probability(spec.numeric)), 2)).withColumn("y", F.col("label").cast("int"))
    a = evaluate.roc_auc(scored, "y", "p").first()["auc"]
    vec = VectorAssembler(inputCols=spec.numeric, outputCol="features")
    theirs = GBTClassifier(maxIter=10, maxDepth=4, stepSize=0.1, seed=1).fit(vec.transform(train)).transform(vec.transform(test))
    b = evaluate.roc_auc(theirs.select(ml.vector_to_array("probability")[1].alias("p"), F.col("label").cast("int").alias("y")), "y", "p").first()["auc"]
    assert a >= b - 0.01 and a > 0.7


def test_a_lost_save_leaves_the_model_before_it(spark, monkeypatch):
    df = processed(spark, SF_SMALL, "fx1").select("transaction_id", "amount", "hour", "card_type", "is_fraud")
    monkeypatch.setattr(boosting, "ROUNDS", 3)
    monkeypatch.setattr(ml, "fit_booster", lambda *a: boosting.fit_booster(*a, rounds=3, depth=3))
    first, _ = ml.train_model(df, "xgboost", cross_validation=False)
    second, _ = ml.train_model(df, "logistic_regression", cross_validation=False)
    path = scratch_path(spark, "model")
    with pytest.raises(ValueError):
        ml.load_model(path, spark)
    ml.save_model(first, path)

    def lost(*_):
        raise RuntimeError("the driver is lost")
    with monkeypatch.context() as m:
        m.setattr(ml, "manifests", lost)  # everything is written but the manifest
        with pytest.raises(RuntimeError):
            ml.save_model(second, path)
    assert ml.load_model(path, spark).booster == first.booster
    ml.save_model(second, path)
    assert ml.load_model(path, spark).weights == second.weights and ml.load_model(path, spark, 1).booster == first.booster
    p = ml.score(ml.load_model(path, spark, 1), df).select("transaction_id", "fraud_probability")
    assert p.exceptAll(ml.score(first, df).select("transaction_id", "fraud_probability")).count() == 0


def test_folds_side_by_side_score_as_one_after_the_other(spark):
    df = processed(spark, SF_SMALL, "fx1").select("transaction_id", "amount", "hour", "is_fraud")
    spec = ml.feature_spec(df)
    data = ml.prepare(df, spec).persist()
    took = {}
    for at_once in (1, 5):
        start = time.time()
        took[at_once] = (ml.cross_validate(data, spec, "logistic_regression", at_once=at_once), time.time() - start)
    assert took[1][0] == took[5][0] and not math.isnan(took[1][0]["cv_f1_mean"])
