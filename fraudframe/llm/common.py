"""Shared helpers of the training-data operators.

Everything written to disk goes through :func:`fraudframe.session.materialize`, i.e. under
``spark.checkpoint.dir``; an executor that is lost costs a recomputation of its own tasks only.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, release

#: Words everywhere in this package: maximal runs of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows per Arrow batch.  Texts may be very long, so a batch stays far below the default 10,000 rows.
ARROW_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SHIPPED: set[str] = set()


def small_batches(df: DataFrame) -> DataFrame:
    """Ready ``df`` for the Python stages that follow.

    Bounds the memory of one Arrow batch (a session setting), and on a local master makes this
    package importable for the workers; a cluster gets it as any package (``--py-files``).
    """
    conf, context = df.sparkSession.conf, df.sparkSession.sparkContext
    if re.fullmatch(r"local(\[.*\])?", context.master) and context.applicationId not in _SHIPPED:
        context.addFile(str(Path(__file__).resolve().parents[1]), recursive=True)
        _SHIPPED.add(context.applicationId)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))
    return df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_pid(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """Range-partition by ``keys`` and write the rows with their partition number ``_pid``.

    Writing fixes the numbers: range bounds come from a sample and must not be drawn twice.
    Partition numbers ascend with the keys and equal keys share a partition, so the last key
    should make rows all but unique.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id())
    return materialize(ranged, name)


def row_key(df: DataFrame, key: str) -> list[Column]:
    """Three plain columns that rows share only if they have the same ``key`` and the same content."""
    return [F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k1"), F.col(key).isNull().alias("_k2"),
            F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("_k3")]


KEYS = ["_k1", "_k2", "_k3"]


def rows_of(df: DataFrame, key: str, chosen: DataFrame, *more: str) -> DataFrame:
    """(``_row``, the ``more`` columns of ``chosen``) for each key of ``chosen`` (unique), one row even if repeated.

    The rows move once, to the partition of their key, where the join and the choice both happen.
    """
    packed = df.select(*row_key(df, key), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    chosen = chosen.select(*[F.col(c).alias(f"{c}c") for c in KEYS], *more)
    same = F.lit(True)
    for c in KEYS:
        same = (packed[c] == chosen[f"{c}c"]) if c == KEYS[0] else same & (packed[c] == chosen[f"{c}c"])
    met = packed.hint("merge").join(chosen, same)
    return met.groupBy(*KEYS).agg(F.first("_row").alias("_row"), *[F.first(c).alias(c) for c in more])


def running_total(ranged: DataFrame, value: str, order: list[Column], out: str,
                  within: tuple[str, ...] = ()) -> DataFrame:
    """Inclusive running sum of ``value`` in key order over a :func:`with_pid` table.

    ``within`` restarts the sum per group (null is a group).  One row per (partition, group) is
    summed ahead, so neither the whole table nor a hot group is ever in one task.
    """
    g = list(within)
    parts = ranged.groupBy("_pid", *g).agg(F.sum(value).alias("_part"))
    before = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_part").over(before), F.lit(0).cast("long")))
    parts = parts.select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in g], "_before")
    cond = F.col("_pid") == F.col("_p")
    for c in g:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    inside = Window.partitionBy("_pid", *g).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("_inside", F.sum(value).over(inside))
    return (summed.join(parts, cond).withColumn(out, F.col("_before") + F.col("_inside"))
            .drop("_p", *[f"_g_{c}" for c in g], "_before", "_inside"))


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x"),
                  F.sum(F.xxhash64("dst", "src") % 1_000_003).alias("s")).first()
    return r["n"], r["x"], r["s"]


def _with_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v) pairs with the smallest of u's neighbours and u itself as ``m``."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return pairs.join(low, F.col("u") == F.col("_u")).drop("_u")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(src, dst) long pairs -> (node, root): root is the smallest node reachable.

    Alternating large-star and small-star steps; every round is written under the checkpoint
    folder, so lineage stays short.  A star of any size is a partial aggregate and a join, never a
    collected group (the join's aggregated side is not written, so a hub's edges stay in one join task).
    Nodes without an edge are not returned.
    """
    e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"))
    e = e.where(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    e = materialize(e, name)
    seen = _signature(e)
    while seen[0]:
        both = e.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionAll(
            e.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        large = _with_minimum(both).where(F.col("v") > F.col("u")).select(
            F.col("v").alias("src"), F.col("m").alias("dst")).where("src != dst").distinct()
        large = materialize(large, name)
        down = large.select(F.col("src").alias("u"), F.col("dst").alias("v"))
        star = _with_minimum(down)
        small = star.select(F.col("v").alias("src"), F.col("m").alias("dst")).unionAll(
            star.select(F.col("u").alias("src"), F.col("m").alias("dst")))
        before, e = e, materialize(small.where("src != dst").distinct(), name)
        release(before)
        release(large)
        now = _signature(e)
        if now == seen:
            break
        seen = now
    roots = e.groupBy("src").agg(F.min("dst").alias("root"))
    return (roots.select(F.col("src").alias("node"), "root")
            .unionAll(e.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()))
