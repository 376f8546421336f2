"""Whole-table order statistics without a single-partition sort.

``order_statistics`` turns a column into a table with one row per distinct
value (per group) holding its multiplicity and how many rows / distinct
values sort below it.  Average-rank percentiles, exact quantiles with linear
interpolation, dense category codes and the rank-sum AUC are all read off
that table.

Plan: partial-aggregated ``groupBy(value)`` -> ``repartitionByRange(P)`` ->
tag ``spark_partition_id`` -> materialise under the checkpoint folder (range
sampling must run once, the tags must not move on recomputation) -> collect
the per-partition totals (at most P + groups rows) -> prefix offsets,
broadcast -> running sums inside each partition.  The only unpartitioned
step is the prefix sum over P numbers on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .select import quantile_frame


@dataclass
class OrderStats:
    """Distinct-value table plus group totals.

    ``table`` columns: *groups, value, cnt, [wsum], rows_below, distinct_below,
    n_total, d_total.
    """

    table: DataFrame
    groups: list[str]
    totals: dict | None  # group tuple -> (n_rows, n_distinct); None when left lazy
    distinct: int  # exact, or an upper estimate on the lazy path
    counts: DataFrame | None = None  # (groups, value, cnt) before ranking
    parts: list | None = None  # ranged path: (group key, pid, rows before pid, rows in pid)

    @property
    def lookup_rows(self) -> int:
        """Row count bound of ``table`` (for the broadcast decision)."""
        return int(self.distinct * 1.1) + 1


# Distinct tables up to this size are ranked by one window task (bounded
# work); larger ones go through the range-partitioned path.
SMALL_DISTINCT = 500_000


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return int(partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def estimate_distinct(df: DataFrame, value: str | Column, groups: list[str] | tuple = ()) -> int:
    """HyperLogLog estimate of the distinct (group, value) count (one cheap aggregate)."""
    vcol = F.col(value) if isinstance(value, str) else value
    key = F.struct(*[F.col(g) for g in groups], vcol.alias("value")) if groups else vcol
    return int(df.agg(F.approx_count_distinct(key, 0.02)).first()[0])


# Distinct values per range partition: the rank table is cut by its own size, not by the input's.
RANGED_ROWS = 200_000


def ranged_partitions(df: DataFrame, distinct: int) -> int:
    return max(2, min(_partitions(df, None), math.ceil(distinct / RANGED_ROWS)))


def _counts(df: DataFrame, value, groups: list[str], weight: Column | None) -> DataFrame:
    vcol = F.col(value) if isinstance(value, str) else value
    cols = [F.col(g) for g in groups] + [vcol.alias("value")]
    if weight is not None:
        cols.append(weight.alias("_w"))
    base = df.select(*cols).where(F.col("value").isNotNull())
    aggs = [F.count(F.lit(1)).alias("cnt")]
    if weight is not None:
        aggs.append(F.sum("_w").alias("wsum"))
    # Partial aggregation on the map side: a hot value costs one row per task.
    return base.groupBy(*groups, "value").agg(*aggs)


def _keep(groups, weight) -> list[str]:
    return [*groups, "value", "cnt"] + (["wsum"] if weight is not None else []) + [
        "rows_below", "distinct_below", "n_total", "d_total"]


def order_statistics(df: DataFrame, value: str | Column, groups: list[str] | tuple = (),
                     weight: Column | None = None, partitions: int | None = None,
                     distinct_estimate: int | None = None, path: str = "auto") -> OrderStats:
    """Order statistics of ``value`` (nulls excluded), optionally per group.

    ``groups`` is meant for a few groups (classes): per-partition totals are
    collected per (partition, group).

    ``weight`` adds ``wsum``: the sum of the weight per distinct value (e.g.
    the number of positives per score, for the rank-sum AUC).
    ``distinct_estimate`` (an upper estimate of the distinct count, e.g. from
    an aggregate the caller already runs) skips the estimating job.
    ``path``: "bounded" or "ranged" fixes the plan, "auto" takes the bounded one up to
    ``SMALL_DISTINCT`` (group, value) pairs; both give the same table.
    """
    if path not in ("auto", "bounded", "ranged"):
        raise ValueError(f"unknown path: {path}")
    groups = list(groups)
    counts = _counts(df, value, groups, weight)
    d_est = distinct_estimate if distinct_estimate is not None else estimate_distinct(df, value, groups)
    if path == "bounded" or (path == "auto" and d_est * 1.1 <= SMALL_DISTINCT):
        return _small_order_statistics(counts, groups, weight, d_est)
    return _ranged_order_statistics(df, counts, groups, weight, partitions or ranged_partitions(df, d_est))


def _small_order_statistics(counts: DataFrame, groups: list[str], weight, d_est: int) -> OrderStats:
    """Bounded distinct table: running sums in one window per group, all lazy."""
    w = Window.partitionBy(*groups).orderBy("value")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*groups)
    table = counts.select(
        "*",
        (F.sum("cnt").over(running) - F.col("cnt")).alias("rows_below"),
        (F.row_number().over(w) - 1).alias("distinct_below"),
        F.sum("cnt").over(whole).alias("n_total"),
        F.count(F.lit(1)).over(whole).alias("d_total"))
    return OrderStats(table.select(*_keep(groups, weight)), groups, None, d_est, counts=counts)


def _ranged_order_statistics(df: DataFrame, counts: DataFrame, groups: list[str], weight,
                             partitions: int | None) -> OrderStats:
    p = _partitions(df, partitions)
    ranged = (counts.repartitionByRange(p, *groups, "value")
              .withColumn("pid", F.spark_partition_id()))
    ranged = materialize(ranged, "order-stats")

    parts = (ranged.groupBy("pid", *groups)
             .agg(F.count(F.lit(1)).alias("d"), F.sum("cnt").alias("n"))
             .collect())
    # Prefix sums per group across partition ids (partition order = value order).
    rows = sorted(((tuple(r[g] for g in groups), r["pid"], r["d"], r["n"]) for r in parts),
                  key=lambda t: (t[1],))
    totals: dict = {}
    offsets = []
    part_list = []
    for key, pid, d, n in rows:
        n0, d0 = totals.get(key, (0, 0))
        offsets.append((pid, *key, n0, d0))
        part_list.append((key, pid, n0, n))
        totals[key] = (n0 + n, d0 + d)
    src_schema = {f.name: f.dataType for f in ranged.schema.fields}
    fields = [T.StructField("pid", T.IntegerType())]
    fields += [T.StructField(g, src_schema[g]) for g in groups]
    fields += [T.StructField("off_rows", T.LongType()), T.StructField("off_distinct", T.LongType())]
    spark = df.sparkSession
    off_df = spark.createDataFrame(offsets, T.StructType(fields))
    tot_rows = [(*k, v[0], v[1]) for k, v in totals.items()]
    tot_fields = [T.StructField(g, src_schema[g]) for g in groups]
    tot_fields += [T.StructField("n_total", T.LongType()), T.StructField("d_total", T.LongType())]
    tot_df = spark.createDataFrame(tot_rows, T.StructType(tot_fields))

    # Both lookup tables hold at most P + #groups rows: broadcast is bounded.
    w = Window.partitionBy("pid", *groups).orderBy("value")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = (ranged.join(F.broadcast(off_df), ["pid", *groups], "inner")
             .withColumn("rows_below", F.col("off_rows") + F.sum("cnt").over(running) - F.col("cnt"))
             .withColumn("distinct_below", F.col("off_distinct") + F.row_number().over(w) - 1))
    if groups:
        table = table.join(F.broadcast(tot_df), groups, "inner")
    else:
        n_all, d_all = totals.get((), (0, 0))
        table = table.withColumn("n_total", F.lit(n_all).cast("long")).withColumn(
            "d_total", F.lit(d_all).cast("long"))
    d = sum(v[1] for v in totals.values())
    return OrderStats(table.select(*_keep(groups, weight), "pid"), groups, totals, d,
                      counts=counts, parts=part_list)


def average_rank_pct(stats: OrderStats, doubled: bool = False) -> DataFrame:
    """``value -> pct``: average rank of ties / count (pandas ``rank(pct=True)``).

    ``doubled`` adds ``rank2``, twice the average rank, an exact integer.
    """
    t = stats.table
    pct = (F.col("rows_below") + (F.col("cnt") + 1) / 2.0) / F.col("n_total")
    rank2 = [(2 * F.col("rows_below") + F.col("cnt") + 1).alias("rank2")] if doubled else []
    return t.select(*stats.groups, "value", pct.alias("pct"), *rank2)


def quantiles(stats: OrderStats, probs: list[float], names: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas/numpy default), per group.

    Bounded distinct table: ``percentile(value, p, cnt)`` over the (value,
    count) rows -- its buffer holds at most the checked number of distinct
    values.  Range-partitioned table: the order statistics k0 = floor((n-1)p)
    and k0+1 are located in the partitions the driver-side offsets point to,
    and only those partitions are ranked (the pid filter sits below the window).
    """
    names = names or [f"q{i}" for i in range(len(probs))]
    if stats.parts is None:
        aggs = [F.percentile("value", F.lit(float(p)), F.col("cnt")).alias(nm)
                for p, nm in zip(probs, names)]
        return stats.counts.groupBy(*stats.groups).agg(*aggs)
    wanted = set()
    for key, (n_rows, _) in stats.totals.items():
        for p in probs:
            h = (n_rows - 1) * p
            for k in {math.floor(h), min(math.floor(h) + 1, n_rows - 1)}:
                for gkey, pid, before, inside in stats.parts:
                    if gkey == key and before <= k < before + inside:
                        wanted.add(pid)
    t = stats.table.where(F.col("pid").isin(sorted(wanted))) if wanted else stats.table.limit(0)
    n1 = (F.col("n_total") - 1).cast("double")
    lo, hi = F.col("rows_below"), F.col("rows_below") + F.col("cnt")
    aggs = []
    conds = []
    for p, name in zip(probs, names):
        h = n1 * F.lit(float(p))
        k0 = F.floor(h)
        k1 = F.least(k0 + 1, F.col("n_total") - 1)
        in0 = (lo <= k0) & (k0 < hi)
        in1 = (lo <= k1) & (k1 < hi)
        conds += [in0, in1]
        aggs += [F.max(F.when(in0, F.col("value"))).alias(f"_{name}_v0"),
                 F.max(F.when(in1, F.col("value"))).alias(f"_{name}_v1"),
                 F.max(h - k0).alias(f"_{name}_f")]
    any_cond = conds[0]
    for c in conds[1:]:
        any_cond = any_cond | c
    agg = t.where(any_cond).groupBy(*stats.groups).agg(*aggs)
    out = [F.col(g) for g in stats.groups]
    for name in names:
        v0, v1, fr = F.col(f"_{name}_v0"), F.col(f"_{name}_v1"), F.col(f"_{name}_f")
        out.append((v0 + (v1 - v0) * fr).alias(name))
    return agg.select(*out)


def quantile_table(df: DataFrame, value: str, probs: list[float], names: list[str], groups: list[str] | tuple = (),
                   path: str = "auto", distinct_estimate: int | None = None) -> DataFrame:
    """Exact quantiles where nothing else of the order is needed, one row per group.

    Few distinct values are counted in one lazy aggregate; many are never shuffled at all but found by radix selection.
    ``path`` as in :func:`order_statistics` ("ranged": the plan for many values).
    """
    d_est = distinct_estimate if distinct_estimate is not None else 0 if path != "auto" else estimate_distinct(df, value, groups)
    if path == "bounded" or (path == "auto" and d_est * 1.1 <= SMALL_DISTINCT):
        return quantiles(order_statistics(df, value, groups, distinct_estimate=d_est, path="bounded"), probs, names)
    if len(groups) > 1:
        raise ValueError("radix selection takes one group column")
    return quantile_frame(df, value, probs, names, groups[0] if groups else None)


def quantile_values(stats: OrderStats, probs: list[float]) -> list[float | None]:
    """Quantiles of an ungrouped table as Python floats (one tiny job)."""
    row = quantiles(stats, probs).first()
    if row is None:
        return [None for _ in probs]
    return [row[i] for i in range(len(probs))]


def dense_codes(stats: OrderStats) -> DataFrame:
    """``value -> code, freq``: 0-based position in sorted distinct order and count."""
    return stats.table.select(*stats.groups, "value", F.col("distinct_below").alias("code"),
                              F.col("cnt").alias("freq"))
