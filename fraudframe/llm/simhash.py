"""SimHash near-duplicates by multi-index hashing.

A text is lower-cased (A-Z only) and cut into words; its shingles are runs of ``shingle`` words
with repeats (a shorter text is one shingle, no words give fingerprint zero).  A fingerprint bit
is 1 if it is set in over half of the shingles' XXH64 values.

The 64 bits are cut into segments with a small radius each, such that two fingerprints within the
distance agree up to the radius in at least one segment (the radii plus one add up to more than
the distance).  Each distinct fingerprint enters one table row per segment and looks up the small
Hamming ball around its own segment; matches are verified on all 64 bits inside the join.  Equal
fingerprints are one row, so exact copies cost nothing and only links between different
fingerprints are ever emitted.

Defined results: null text is a text without words; a null id stays null, its row still links
its group; repeated rows are separate members with equal fingerprints; an empty table gives an
empty result; other columns are ignored (:func:`simhash_groups`) or kept (:func:`dedup`).
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import KEYS, components, row_key, rows_of, small_batches

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: (first bit, width, radius).  24 + 24 + 1 lookups per fingerprint.  Chance candidates of one among n are about
#: n * 10^-5, some 100 at 10^7 distinct fingerprints; far beyond that pass TWO_SEGMENTS: many more
#: lookups, 2^-32 selectivity.
SEGMENTS = ((0, 23, 1), (23, 23, 1), (46, 18, 0))
TWO_SEGMENTS = ((0, 32, 2), (32, 32, 1))


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash as a signed long."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    tails = ends[shingle - 1:] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b - 1], 42) for a, b in zip(starts, tails)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 8192):  # a very long text never unpacks at once
        part = hashes[i:i + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, shingle: int = 4) -> Column:
    @F.pandas_udf("long")
    def simhash(s: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in s], dtype="int64")
    return simhash(text)


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(width), r)]


def _around(key: Column, ball: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(m).cast("long") for m in ball]), lambda m: key.bitwiseXOR(m))


def links(distinct: DataFrame, max_distance: int = 4, segments=SEGMENTS) -> DataFrame:
    """All (src, dst), src < dst, of distinct ``fp`` values within ``max_distance`` bits.

    A pair found by several segments is returned as often.
    """
    if sum(r + 1 for _, _, r in segments) <= max_distance:
        raise ValueError("the segments' radii do not cover max_distance")
    keys, probes = [], []
    for i, (first, width, radius) in enumerate(segments):
        key = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(i << 40)
        keys.append(key)
        probes.append(_around(key, _ball(width, radius)))
    rows = distinct.select(F.col("fp").alias("dst"), F.explode(F.array(*keys)).alias("k"))
    asks = distinct.select(F.col("fp").alias("src"), F.explode(F.concat(*probes)).alias("k"))
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_distance
    return asks.join(rows, (asks["k"] == rows["k"]) & (F.col("src") < F.col("dst")) & near).select("src", "dst")


def roots(fps: DataFrame, max_distance: int = 4, segments=SEGMENTS) -> DataFrame:
    """Every distinct ``fp`` of ``fps`` with the smallest fingerprint ``root`` of its group."""
    distinct = materialize(fps.select("fp").distinct(), "simhash-distinct")
    linked = components(links(distinct, max_distance, segments), "simhash-components")
    return (distinct.join(linked, distinct["fp"] == linked["node"], "left")
            .select("fp", F.coalesce("root", "fp").alias("root")))


def simhash_groups(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4,
                   max_distance: int = 4, segments=SEGMENTS) -> DataFrame:
    """One row per row of ``df``: key, fingerprint (hex), component_id (smallest key of the group)."""
    fps = small_batches(df).select(F.col(key).alias("id"), fingerprint_column(F.col(text), shingle).alias("fp"))
    fps = materialize(fps, "simhash-fingerprints")
    groups = roots(fps, max_distance, segments)
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    least = materialize(groups.join(least, "fp"), "simhash-groups")
    smallest = materialize(least.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-roots")
    named = materialize(least.join(smallest, "root").select("fp", "component_id"), "simhash-named")
    # Both sides are read from files, so AQE can split the partition of a fingerprint with many copies.
    named = named.withColumnRenamed("fp", "_fp")
    return fps.join(named, F.col("fp") == F.col("_fp")).select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4,
          max_distance: int = 4, segments=SEGMENTS) -> DataFrame:
    """The row with the smallest key of every group (of equal keys any one), all columns kept."""
    narrow = small_batches(docs).select(F.col(key).alias("id"), *row_key(docs, key),
                                        fingerprint_column(F.col(text), shingle).alias("fp"))
    narrow = materialize(narrow, "simhash-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("missing"), "id", *KEYS)).alias("first")
    least = narrow.groupBy("fp").agg(first)
    keep = (least.join(roots(narrow, max_distance, segments), "fp").groupBy("root").agg(F.min("first").alias("first"))
            .select(*[F.col(f"first.{c}").alias(c) for c in KEYS]))
    return rows_of(docs, key, materialize(keep, "simhash-keep")).select("_row.*")
