"""Logistic regression by Newton steps (iteratively reweighted least squares).

Minimises C * sum(w * log-loss) + |b|^2 / 2 over the coefficients b (the intercept is free).  With few features the
second derivative is a small matrix, so each step costs one pass: every task adds up the loss, the gradient
X'w(p - y) and the Gram matrix X'WX of its rows, which stay with the executors as blocks of arrays, and the driver solves
a system as wide as the features.  The loss is convex and the steps are halved when they overshoot, so
a handful of passes reaches the optimum to the last digits, collinear columns included (the
penalty makes the matrix definite).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .blocks import added_up

#: Rows whose products are added up at once in a task.
CHUNK = 4096
MAX_PASSES = 60


@dataclass
class LogisticFit:
    weights: list[float]   # intercept, then one per feature
    gradient: float        # largest partial derivative of the objective, per unit of total weight
    passes: int

    def stages(self, inputs: list[str]) -> list:
        """Stages that score the columns ``inputs``: probability (vector) and prediction."""
        terms = [repr(self.weights[0])] + [f"`{c}` * {w!r}" for c, w in zip(inputs, self.weights[1:])]
        return [
            SQLTransformer(statement=f"SELECT *, {' + '.join(terms)} AS _margin FROM __THIS__"),
            SQLTransformer(statement="SELECT *, 1 / (1 + exp(_margin)) AS _p0, 1 / (1 + exp(-_margin)) AS _p1, "
                                     "CAST(_margin > 0 AS DOUBLE) AS prediction FROM __THIS__"),
            VectorAssembler(inputCols=["_p0", "_p1"], outputCol="probability", handleInvalid="keep")]


def _blocks(rows: DataFrame, width: int) -> RDD:
    """``rows`` (x, y, w) as blocks of up to ``CHUNK`` rows, (1 and x as a matrix, y, w)."""
    def batches(parts):
        for batch in parts:
            n = batch.num_rows
            x = np.column_stack([np.ones(n), batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, width - 1)])
            y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for at in range(0, n, CHUNK):
                yield pa.record_batch([pa.array([v[at:at + CHUNK].tobytes()], pa.binary()) for v in (x, y, w)], ["x", "y", "w"])

    def arrays(r) -> tuple:
        y, w = np.frombuffer(r["y"], np.float64), np.frombuffer(r["w"], np.float64)
        return np.frombuffer(r["x"], np.float64).reshape(len(y), width), y, w

    blocks = rows.mapInArrow(batches, "x binary, y binary, w binary").rdd.map(arrays)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if blocks.getNumPartitions() < cores:
        blocks = blocks.repartition(cores)
    return blocks


def _sums(rows: DataFrame | RDD, beta: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(total weight, loss, gradient, second derivative) of sum(w * log-loss) at ``beta``, in one pass over rows or their blocks."""
    q = len(beta)
    blocks = _blocks(rows, q) if isinstance(rows, DataFrame) else rows

    def add_up(part):
        total = np.zeros(2 + q + q * q)
        for x, y, w in part:
            margin = x @ beta
            p = np.where(margin >= 0, 1 / (1 + np.exp(-np.abs(margin))), 1 - 1 / (1 + np.exp(-np.abs(margin))))
            total[0] += w.sum()
            total[1] += (w * (np.logaddexp(0, margin) - y * margin)).sum()
            total[2:2 + q] += x.T @ (w * (p - y))
            total[2 + q:] += (x.T @ (x * (w * p * (1 - p))[:, None])).ravel()
        yield total

    got = np.zeros(2 + q + q * q) + added_up(blocks.mapPartitions(add_up), 2 + q + q * q)
    return got[0], got[1], got[2:2 + q], got[2 + q:].reshape(q, q)


def fit_logistic(vec: DataFrame, c: float = 1.0, tol: float = 1e-9, features: str = "features", label: str = "label",
                 weight: str = "weight") -> LogisticFit:
    """The optimum over ``vec`` (a vector column, a 0/1 label and a row weight)."""
    rows = vec.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"))
    first = vec.select(F.size(vector_to_array(features))).first()
    q = (first[0] if first else 0) + 1
    ship_package(vec.sparkSession)
    blocks = _blocks(rows, q).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _minimum(blocks, q, c, tol)
    finally:
        blocks.unpersist()


def _minimum(blocks: RDD, q: int, c: float, tol: float) -> LogisticFit:
    beta, step, passes = np.zeros(q), np.zeros(q), 0
    best = None  # (objective, gradient, Hessian) at beta
    share = 1.0
    while True:
        here = beta - share * step
        total, loss, gradient, hessian = _sums(blocks, here)
        passes += 1
        own = np.concatenate([[0.0], here[1:]])
        objective, gradient = c * loss + own @ own / 2, c * gradient + own
        hessian = c * hessian + np.diag([0.0] + [1.0] * (q - 1))
        if best is not None and objective > best[0] - 1e-4 * share * (best[1] @ step) + 1e-12 * abs(best[0]) and passes < MAX_PASSES:
            share /= 2  # overshot: half the step
            continue
        beta, best = here, (objective, gradient, hessian)
        off = float(np.abs(gradient).max() / max(total, 1e-300))
        if off < tol or passes >= MAX_PASSES:
            return LogisticFit(beta.tolist(), off, passes)
        step, share = np.linalg.lstsq(hessian, gradient, rcond=None)[0], 1.0
        if gradient @ step <= 1e-22 * max(abs(objective), 1.0):
            return LogisticFit(beta.tolist(), off, passes)  # nothing left to gain in double precision
