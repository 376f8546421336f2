"""Moments of all column pairs over the rows where both are present, in one pass for any number of columns.

With D the values less a shift (0 where missing) and M the 0/1 matrix of what is present, the sums for
every pair are four matrix products per batch: M'M (rows), D'M (sums), (D*D)'M (squares) and D'D (products).
Every batch takes its own means for the shift, so its sums are well conditioned whatever the data;
partial results are brought to a common shift exactly when they are added up, batch by batch in a task, tasks in
groups, groups on the driver, which ends with four matrices as wide as the columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Rows multiplied at once, and tasks added up by one task.
CHUNK, GROUP = 8192, 64


@dataclass
class Moments:
    """Per pair (i, j): rows with both, and over them the sums of d_i, d_i^2 and d_i d_j; per column lowest and highest value."""

    n: np.ndarray
    s: np.ndarray
    q: np.ndarray
    p: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def covariance(self) -> tuple[np.ndarray, np.ndarray]:
        """(covariance of i and j, variance of i) over the rows with both."""
        with np.errstate(invalid="ignore", divide="ignore"):
            cov = self.p / self.n - (self.s / self.n) * (self.s.T / self.n)
            var = self.q / self.n - (self.s / self.n) ** 2
        # What is left of a constant by rounding is no variance.
        return cov, np.where(var <= 1e-13 * (self.q / np.maximum(self.n, 1)), 0.0, var)


def _unpacked(x: np.ndarray, k: int) -> tuple:
    """n, s, q, p (matrices); shift, low, high (per column)."""
    return *x[:4 * k * k].reshape(4, k, k), *x[4 * k * k:].reshape(3, k)


def _packed(*parts: np.ndarray) -> np.ndarray:
    return np.concatenate([p.ravel() for p in parts])


def _batch(x: np.ndarray) -> np.ndarray:
    there = ~np.isnan(x)
    m, rows = there.astype(float), there.sum(0)
    shift = np.where(there, x, 0.0).sum(0) / np.maximum(rows, 1)
    d = np.where(there, x - shift, 0.0)
    return _packed(m.T @ m, d.T @ m, (d * d).T @ m, d.T @ d, shift, np.fmin.reduce(x), np.fmax.reduce(x))


def _add(a: np.ndarray | None, b: np.ndarray, k: int) -> np.ndarray:
    """Two packed partial results as one, around the shift of the first (of the second for a column new to it)."""
    if a is None:
        return b
    (na, sa, qa, pa_, ca, la, ha), (nb, sb, qb, pb, cb, lb, hb) = _unpacked(a, k), _unpacked(b, k)
    c = np.where(np.diag(na) > 0, ca, cb)

    def around(n, s, q, p, own):
        e = np.where(np.diag(n) > 0, own - c, 0.0)
        i, j = e[:, None], e[None, :]
        return s + n * i, q + 2 * i * s + n * i * i, p + j * s + i * s.T + n * i * j
    sums = [x + y for x, y in zip(around(na, sa, qa, pa_, ca), around(nb, sb, qb, pb, cb))]
    return _packed(na + nb, *sums, c, np.fmin(la, lb), np.fmax(ha, hb))


def pair_moments(df: DataFrame, columns: list[str]) -> Moments:
    """Moments of all pairs of numeric ``columns``; nulls and NaN are missing."""
    k = len(columns)
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def record(total, number):
        return pa.record_batch([pa.array([number], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["number", "sums"])

    def one_task(batches):
        from pyspark import TaskContext
        total = None
        for batch in batches:
            whole = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            for at in range(0, len(whole), CHUNK):
                total = _add(total, _batch(whole[at:at + CHUNK]), k)
        if total is not None:
            yield record(total, TaskContext.get().partitionId())

    def together(table: pa.Table) -> pa.Table:
        total = None
        for sums in table.sort_by("number").column("sums"):
            total = _add(total, sums.values.to_numpy(), k)
        return pa.Table.from_batches([record(total, table.column("number")[0].as_py() // GROUP)])

    kind = "number long, sums array<double>"
    ship_package(df.sparkSession)
    groups = rows.mapInArrow(one_task, kind).groupBy(F.expr(f"number div {GROUP}")).applyInArrow(together, kind)
    total = None
    for sums in groups.toArrow().sort_by("number").column("sums"):
        total = _add(total, sums.values.to_numpy(), k)
    if total is None:
        total = np.concatenate([np.zeros(4 * k * k + k), np.full(2 * k, np.nan)])
    n, s, q, p, _, low, high = _unpacked(total, k)
    return Moments(n, s, q, p, low, high)
