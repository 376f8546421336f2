"""Exact order statistics by radix selection.

To find the k-th smallest value of a column there is no need to sort it.  Values get a 64-bit key in the same
order (neighbours may share one); a histogram of the keys' leading 16 bits says which bucket holds the k-th row, and only
that bucket is looked at again, 16 bits further, until few enough keys are left to name the value.
Every pass is one scan with a partial aggregate: at most 65,536 counters per task and group are shuffled, never
the values themselves, and nothing is written.  All wanted ranks of all groups go down together.

Two or three passes are enough for any number of rows whose keys are spread; a hot value costs no more than
any other, because a bucket is narrowed by its keys and not by its rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits per pass, and the rows in the wanted buckets from which their values are counted outright.
DIGIT = 16
FEW = 20_000


def double_key(x: Column) -> Column:
    """A long that sorts like a double (no NaN): its logarithm as a fixed-point number, with its sign.

    Each step keeps the order; some thousand neighbouring doubles at most share a key.
    """
    size = F.least(F.log2(F.abs(x)) + 1075.0, F.lit(2100.0))  # 1 for the smallest number, 2099 for the largest
    return F.when(x == 0, F.lit(0).cast("long")).otherwise((F.signum(x) * size * float(1 << 51)).cast("long"))


def hex_key(x: Column) -> Column:
    """The first 60 bits of a text of hex digits."""
    return F.conv(F.substring(x, 1, 15), 16, 10).cast("long")


def ordered_key(x: Column, kind: T.DataType) -> Column:
    """A long that sorts like ``x``; values with equal keys are told apart by themselves."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return double_key(x.cast("double"))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return x.cast("long")
    if isinstance(kind, T.DecimalType):
        return double_key(x.cast("double"))  # rounds in order
    if isinstance(kind, T.DateType):
        return F.unix_date(x).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(x)
    raise TypeError(f"no ordered key for {kind.simpleString()}")


def _prefix(key: Column, level: int) -> Column:
    """The leading ``level`` digits of a key, as a number."""
    return F.shiftright(key, 64 - DIGIT * level) if level else F.lit(0).cast("long")


def select_ranks(df: DataFrame, value: Column, key: Column, wanted: Callable[[object, int], list[int]],
                 group: Column | None = None) -> dict:
    """{group: (rows, {rank: value})} with ``wanted(group, rows)`` giving the 0-based ranks of each group.

    ``key`` orders as ``value`` does (equal keys may hold different values); rows without value are left out.
    ``group`` is meant for a few groups, such as classes.
    """
    rows = df.select((group if group is not None else F.lit(0)).alias("_g"), value.alias("_v"), key.alias("_k")).where(
        F.col("_v").isNotNull())
    found: dict = {}
    open_: dict = {}  # (group, prefix) -> [(rank, rows of the group before the bucket)]
    level, first = 0, True
    while first or open_:
        held = rows
        if not first:
            inside = F.lit(False)
            for g in {g for g, _ in open_}:
                inside = inside | (F.col("_g").eqNullSafe(F.lit(g)) & _prefix(F.col("_k"), level).isin([p for h, p in open_ if h == g]))
            held = rows.where(inside)
        if not first and (level * DIGIT == 64 or left <= FEW):
            # Few values, or one key per bucket: count them and read the ranks off.
            counted = held.groupBy("_g", _prefix(F.col("_k"), level).alias("_p"), "_k", "_v").count().collect()
            for (g, p), targets in open_.items():
                own = sorted(((r["_k"], r["_v"], r["count"]) for r in counted if r["_g"] == g and r["_p"] == p))
                for rank, before in targets:
                    at = before
                    for _, v, n in own:
                        if rank < at + n:
                            found[g][1][rank] = v
                            break
                        at += n
            break
        counts = held.groupBy("_g", _prefix(F.col("_k"), level + 1).alias("_p")).count().collect()
        by_group: dict = {}
        for r in counts:
            by_group.setdefault(r["_g"], []).append((r["_p"], r["count"]))
        following: dict = {}
        left = 0
        for g, buckets in by_group.items():
            buckets.sort()
            if first:
                n = sum(c for _, c in buckets)
                found[g] = (n, {})
                targets = [(rank, 0, None) for rank in sorted(set(wanted(g, n))) if 0 <= rank < n]
            else:
                targets = [(rank, before, p) for (h, p), ts in open_.items() if h == g for rank, before in ts]
            for rank, before, parent in targets:
                at = before
                for p, c in buckets:
                    if parent is not None and p >> DIGIT != parent:
                        continue
                    if rank < at + c:
                        if (g, p) not in following:
                            left += c
                        following.setdefault((g, p), []).append((rank, at))
                        break
                    at += c
        open_, level, first = following, level + 1, False
    return found


def quantiles(df: DataFrame, value: str, probs: list[float], group: str | None = None) -> dict:
    """{group: [exact quantile with linear interpolation, ...]} of a numeric column (group 0 without ``group``)."""
    def places(_, n):
        return [k for p in probs for k in (math.floor((n - 1) * p), min(math.floor((n - 1) * p) + 1, n - 1))]
    x = F.col(value)
    found = select_ranks(df, x, ordered_key(x, df.schema[value].dataType), places, F.col(group) if group else None)
    out = {}
    for g, (n, at) in found.items():
        out[g] = []
        for p in probs:
            h = (n - 1) * p
            k = math.floor(h)
            low, high = float(at[k]), float(at[min(k + 1, n - 1)])
            out[g].append(low + (high - low) * (h - k))
    return out


def quantile_frame(df: DataFrame, value: str, probs: list[float], names: list[str], group: str | None = None) -> DataFrame:
    """The same as a table: one row per group (without ``group``, one row at all)."""
    found = quantiles(df, value, probs, group)
    fields = [T.StructField(n, T.DoubleType()) for n in names]
    if group:
        fields.insert(0, T.StructField(group, df.schema[group].dataType))
        rows = [(g, *q) for g, q in found.items()]
    else:
        rows = [tuple(found.get(0, [None] * len(names)))]
    return df.sparkSession.createDataFrame(rows, T.StructType(fields))
