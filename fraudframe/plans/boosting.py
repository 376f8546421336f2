"""Second-order gradient boosting of a 0/1 label over histograms.

Features are cut into at most ``BINS`` weighted-quantile bins once; a row is then a few bytes, its label,
weight and margin, and some thousand rows are one block of arrays that stays with its executor.  A tree grows level by
level, one short job a level: every task adds up first and second derivatives of the
log-loss, g = w(p - y) and h = w p(1 - p), per (node, feature, bin) of its rows, a tree of tasks adds up the
sums, and the driver reads the splits off sums whose number depends on the tree and the bins, never on the
rows.  A split gains (GL^2 / (HL + l) + GR^2 / (HR + l) - G^2 / (H + l)) / 2 - gamma, both sides must weigh
``MIN_CHILD`` in h, and a leaf is -rate * G / (H + l).

The first pass of a tree adds the values of the tree before to the margins, so that a pass walks its rows down one tree
only; every ``REFRESH`` trees the blocks are written under the checkpoint folder, which keeps the lineage short.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.select import double_key
from ..session import materialize, release, ship_package
from .blocks import added_up

#: Fixed values of the model: rounds, depth, learning rate, penalty of leaves, least gain, least child weight.
ROUNDS, DEPTH, RATE, LAMBDA, GAMMA, MIN_CHILD = 100, 6, 0.1, 1.0, 0.0, 1.0
#: Bins per feature (a bin number is a byte), and the bits of the ordered key that values are counted by before.
BINS, SKETCH_BITS = 256, 20
REFRESH = 10
#: Rows are kept in blocks; a task has at least and at most so many rows, and a core between them so many tasks.
BLOCK, TASK_ROWS, MOST_ROWS, TASKS_PER_CORE = 4096, 50_000, 2_000_000, 2
COLUMNS = ["bins", "y", "w", "m"]
#: Gains this close count as equal; the first feature and bin wins, so that sums in another order give the same tree.
SAME = 1e-9


@dataclass
class Tree:
    """Node i: feature (-1: a leaf), last bin and value that go left, number of the left child (the right one follows), value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, cut: float) -> None:
        self.feature[node], self.bin[node], self.cut[node], self.left[node] = feature, bin_, cut, len(self.feature)
        for _ in range(2):
            self.feature.append(-1)
            self.bin.append(0)
            self.cut.append(0.0)
            self.left.append(0)
            self.value.append(0.0)


@dataclass
class Booster:
    trees: list[Tree]
    base: float = 0.0  # margin before the first tree

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum_of_trees([walk_arrays(t, t.cut) for t in self.trees], x)

    def probability(self, features: list[str]) -> Column:
        """P(label = 1) as an ML vector of both classes."""
        booster = self

        @F.pandas_udf("double")
        def chance(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            return pd.Series(sigmoid(booster.margins(np.stack(x.to_numpy()).astype(np.float64))))
        p = chance(F.array(*[F.col(f"`{c}`").cast("double") for c in features]))
        return array_to_vector(F.array(1.0 - p, p))

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> Booster:
        return Booster([Tree(**t) for t in d["trees"]], d["base"])


def sigmoid(m: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(m))
    return np.where(m >= 0, 1 / (1 + e), e / (1 + e))


def walk_arrays(tree: Tree, limits: list) -> tuple:
    """A tree as arrays in which a leaf is its own child on either side."""
    feature, left = np.array(tree.feature), np.array(tree.left)
    leaf, here = feature < 0, np.arange(len(feature))
    return (np.where(leaf, 0, feature), np.array(limits), np.where(leaf, here, left), np.where(leaf, here, left + 1),
            np.array(tree.value), depth_of(tree))


def depth_of(tree: Tree) -> int:
    below = [0] * len(tree.feature)
    for node in reversed(range(len(below))):  # children come after their parent
        if tree.feature[node] >= 0:
            below[node] = 1 + max(below[tree.left[node]], below[tree.left[node] + 1])
    return below[0]


def walk(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The node every row ends in."""
    feature, limit, left, right, _, depth = tree
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        node = np.where(x[rows, feature[node]] <= limit[node], left[node], right[node])
    return node


def sum_of_trees(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for t in trees:
        out += t[4][walk(t, x)]
    return out


def weighted_cuts(data: DataFrame, features: list[str], weight: str = "weight", bins: int = BINS) -> list[list[float]]:
    """Per feature, the largest value of each bin; bins of about equal weight, ascending.

    Values are counted by the leading bits of their ordered key, a partial aggregate whose size depends on
    the range of the values only; a value that fills a bin by itself has it alone.
    """
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    each = data.select(F.col(weight).alias("_w"), F.posexplode(values).alias("f", "x"))
    place = F.shiftright(double_key(F.col("x")), 63 - SKETCH_BITS)
    counted = each.groupBy("f", place.alias("k")).agg(F.sum("_w").alias("w"), F.max("x").alias("top"))
    whole, order = Window.partitionBy("f"), Window.partitionBy("f").orderBy("k")
    upto = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1))
    number = F.floor(F.coalesce(upto, F.lit(0.0)) / F.sum("w").over(whole) * (bins - 1))
    found = counted.withColumn("bin", number).groupBy("f", "bin").agg(F.max("top").alias("top")).collect()  # bins rows a feature
    cuts: list[list[float]] = [[] for _ in features]
    for r in sorted(found, key=lambda r: (r["f"], r["top"])):
        cuts[r["f"]].append(r["top"])
    return cuts


def _blocks(data: DataFrame, features: list[str], cuts: list[list[float]], label: str, weight: str) -> DataFrame:
    """(bins, y, w, m): up to ``BLOCK`` rows as one, feature by feature; a bin is one byte, a margin 0 so far."""
    limits = [np.array(c) for c in cuts]

    def block(x: list, y: list, w: list) -> pa.RecordBatch:
        columns = [np.concatenate(part, axis=-1).tobytes() for part in (x, y, w)] + [np.zeros(sum(map(len, y))).tobytes()]
        return pa.record_batch([pa.array([c], pa.binary()) for c in columns], COLUMNS)

    def batches(parts):
        x, y, w, n = [], [], [], 0
        for batch in parts:
            out = np.empty((len(limits), batch.num_rows), np.uint8)
            for i, c in enumerate(limits):
                out[i] = np.minimum(np.searchsorted(c, batch.column(i).to_numpy(zero_copy_only=False), "left"), len(c) - 1)
            values = [batch.column(len(limits) + i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            at = 0
            while at < batch.num_rows:
                end = min(batch.num_rows, at + BLOCK - n)
                for held, part in zip((x, y, w), (out, *values)):
                    held.append(part[..., at:end])
                n, at = n + end - at, end
                if n == BLOCK:
                    yield block(x, y, w)
                    x, y, w, n = [], [], [], 0
        if n:
            yield block(x, y, w)
    rows = data.select(*[F.col(f"`{c}`").cast("double") for c in features], F.col(label).cast("double"), F.col(weight).cast("double"))
    return rows.mapInArrow(batches, ", ".join(f"{c} binary" for c in COLUMNS))


def _spread(table: DataFrame, width: int, tasks: int) -> RDD:
    """The blocks as (bins, y, w, margin) arrays, kept by the executors."""
    def arrays(r) -> tuple:
        y, w, m = (np.frombuffer(v, np.float64) for v in (r["y"], r["w"], r["m"]))
        return np.frombuffer(r["bins"], np.uint8).reshape(width, len(y)), y, w, m
    return table.rdd.map(arrays).coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)


def _frame(spark: SparkSession, rows: RDD) -> DataFrame:
    return spark.createDataFrame(rows.map(lambda b: tuple(bytearray(a.tobytes()) for a in b)), ", ".join(f"{c} binary" for c in COLUMNS))


def _in_place_of(table: DataFrame, blocks: DataFrame) -> DataFrame:
    written = materialize(blocks, "boosting")
    release(table)
    return written


def _raised(rows: RDD, tree: Tree) -> RDD:
    """The blocks with the tree's values added to the margins."""
    past = [walk_arrays(tree, tree.bin)]
    return rows.map(lambda b: (*b[:3], b[3] + sum_of_trees(past, b[0].T)), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)


def _level_sums(rows: RDD, tree: Tree, open_: list[int], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(G, H) per open node and (feature, bin), features laid end to end at ``offsets``; one pass."""
    now = walk_arrays(tree, tree.bin)
    total = int(offsets[-1])
    place = np.full(len(tree.feature), -1)
    place[open_] = np.arange(len(open_))

    def add_up(blocks):
        sums = np.zeros((2, len(open_), total))
        for x, y, w, m in blocks:
            at = place[walk(now, x.T)]
            held = at >= 0
            if not held.all():
                x, y, w, m, at = x[:, held], y[held], w[held], m[held], at[held]
            p = sigmoid(m)
            g, h = w * (p - y), w * p * (1 - p)
            row = at * BINS
            for f, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                slot = row + x[f]
                for out, v in zip(sums, (g, h)):
                    out[:, a:b] += np.bincount(slot, v, len(open_) * BINS).reshape(-1, BINS)[:, :b - a]
        yield sums

    out = np.zeros((2, len(open_), total)) + added_up(rows.mapPartitions(add_up), 2 * len(open_) * total)
    return out[0], out[1]


def best_split(g: np.ndarray, h: np.ndarray, offsets: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, feature, last bin to the left) of one node, None if nothing gains."""
    best: tuple[float, int, int] | None = None
    for f, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        if b - a < 2:
            continue
        gl, hl = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        gt, ht = gl[-1], hl[-1]
        gl, hl = gl[:-1], hl[:-1]
        gains = (gl ** 2 / (hl + LAMBDA) + (gt - gl) ** 2 / (ht - hl + LAMBDA) - gt ** 2 / (ht + LAMBDA)) / 2 - GAMMA
        gains = np.where((hl >= MIN_CHILD) & (ht - hl >= MIN_CHILD), gains, -np.inf)
        top = gains.max()
        if top > 1e-12 and (best is None or top > best[0] * (1 + SAME)):
            best = (float(top), f, int(np.argmax(gains >= top * (1 - SAME))))
    return best


def grow_tree(rows: RDD, cuts: list[list[float]], offsets: np.ndarray, depth: int, rate: float) -> Tree:
    tree, open_ = Tree(), [0]
    for level in range(depth + 1):
        if not open_:
            break
        g, h = _level_sums(rows, tree, open_, offsets)
        following = []
        for i, node in enumerate(open_):
            # Every feature's bins add up to the node's sums.
            gt, ht = g[i, :offsets[1]].sum(), h[i, :offsets[1]].sum()
            tree.value[node] = float(-rate * gt / (ht + LAMBDA))
            found = best_split(g[i], h[i], offsets) if level < depth else None
            if found:
                _, f, b = found
                tree.split(node, f, b, cuts[f][b])
                gl, hl = g[i, offsets[f]:offsets[f] + b + 1].sum(), h[i, offsets[f]:offsets[f] + b + 1].sum()
                for child, (gc, hc) in zip((tree.left[node], tree.left[node] + 1), ((gl, hl), (gt - gl, ht - hl))):
                    tree.value[child] = float(-rate * gc / (hc + LAMBDA))
                    following.append(child)
        # The sums of the last level's children are known from their parents: they need no pass.
        open_ = following if level + 1 < depth else []
    return tree


def fit_booster(data: DataFrame, features: list[str], label: str = "label", weight: str = "weight", rounds: int = ROUNDS,
                depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Booster:
    """Boosted trees over the numeric columns ``features`` of ``data`` (a 0/1 label and a row weight)."""
    ship_package(data.sparkSession)
    cuts = weighted_cuts(data, features, weight, bins)
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in cuts])])
    base, width = 0.0, len(features)
    table = materialize(_blocks(data, features, cuts, label, weight), "boosting")
    # Some hundred passes follow: a task should have enough rows to be worth its start, and the cluster a few tasks a core.
    n = (table.agg(F.sum(F.octet_length("y"))).first()[0] or 0) // 8
    most = max(TASKS_PER_CORE * data.sparkSession.sparkContext.defaultParallelism, -(-n // MOST_ROWS))
    tasks = max(1, min(-(-n // TASK_ROWS), most))
    if table.rdd.getNumPartitions() < tasks:
        table = _in_place_of(table, table.repartition(tasks))
    rows = _spread(table, width, tasks)
    trees: list[Tree] = []
    older: RDD | None = None
    try:
        for i in range(rounds):
            trees.append(grow_tree(rows, cuts, offsets, depth, rate))
            if older is not None:
                older.unpersist()  # the first pass of the tree has filled ``rows``
            if i + 1 == rounds:
                break
            older, rows = rows, _raised(rows, trees[-1])
            if (i + 1) % REFRESH == 0:
                table = _in_place_of(table, _frame(data.sparkSession, rows))
                rows.unpersist()
                older.unpersist()
                older, rows = None, _spread(table, width, tasks)
    finally:
        for held in (older, rows):
            if held is not None:
                held.unpersist()
        release(table)
    return Booster(trees, base)
