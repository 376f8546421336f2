"""Mixing sources to target weights by weighted fair queueing.

Targets.  Source i (by code point, null last) weighs 3, 1, 2, 3, ... and the budget is 150 % of
all words.  A target stops at ``max_epochs`` times its source's size; the excess goes to the
others by weight until none is above.  That fixed point is ``target = least(cap, weight * level)``
for one level, read off the sources sorted by cap / weight.

Schedule.  Within its source each document has a place in a fixed shuffle (md5 of seed and id).  The
e-th epoch of a document finishes at virtual time (words of its source up to it) / target.  The
finish times of all sources are range-sorted together and cut where the running total of words
exceeds the budget; what finishes before the cut is taken, whole documents only.

All running sums are per range partition with summed-ahead offsets: no source, however large, is
in one task.  Per-source rows (not documents) do pass through one window.

Defined results: null text has size 0; a null source is a source of its own; sources without words
have target 0; repeated rows are separate documents; documents of size 0 are taken 0 words; an empty table
gives an empty result; other columns are kept by :func:`mix` and ignored by :func:`schedule`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import KEYS, row_key, rows_of, running_total, with_pid, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size) rows -> source, source_size, target, budget; one row per source."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    src = src.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                            ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    src = src.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    src = src.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    ratio = F.col("_cap") / F.col("_w")
    below = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("_cap").over(below), F.lit(0.0))
    weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(below), F.lit(0.0))
    src = src.withColumn("_level", left / weight)
    level = F.max(F.when(ratio >= F.col("_level"), F.col("_level"))).over(everything)
    target = F.least(F.col("_cap"), F.coalesce(F.col("_w") * level, F.col("_cap")))
    return src.select("source", "source_size", target.alias("target"), "budget")


def _finish(cum: Column, epoch: int) -> Column:
    return F.try_divide((cum + F.lit(epoch) * F.col("source_size")).cast("double"), F.col("target"))


def schedule(docs: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None,
             seed: str = SEED, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """One row per document: key, size, source_size, target, taken (and the ``keep`` columns)."""
    max_epochs = options.get("max_epochs", MAX_EPOCHS)
    rows = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"),
                       (size if size is not None else word_count(F.col("text"))).alias("size"), *keep)
    place = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("_key").cast("string"), F.lit(""))))
    rows = rows.withColumn("_place", place)
    order = [F.col("source"), F.col("_place"), F.col("size")]
    rows = with_pid(rows, order, "mix-shuffled")
    goal = materialize(targets(rows.select("source", "size"), **options), "mix-targets")
    queue = running_total(rows, "size", order[1:], "_cum", within=("source",)).drop("_pid")
    goal = goal.withColumnRenamed("source", "_source")
    queue = queue.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    queue = materialize(queue, "mix-queue")

    # Virtual finish times of every epoch of every document, range-sorted; where the budget ends.
    turns = F.explode(F.array(*[F.struct(_finish(F.col("_cum"), e).alias("f"), F.lit(e).alias("e"))
                                for e in range(max_epochs)]))
    times = queue.where("size > 0 and target > 0").select(
        turns.alias("_t"), "_place", "size", "source", "budget").select("_t.f", "_t.e", "source", "_place", "size", "budget")
    at = [F.col("f"), F.col("source"), F.col("_place"), F.col("size"), F.col("e")]
    times = with_pid(times, at, "mix-times")
    total = running_total(times, "size", at, "_total")
    fits = F.col("_total") <= F.col("budget")
    last = total.where(fits).agg(F.max(F.struct("f", "source", "_place", "size", "e"))
                                 .alias("cut")).select("cut")
    cut = last.first()["cut"]

    def taken(e: int) -> Column:
        if cut is None:
            return F.lit(0).cast("long")
        f, s = _finish(F.col("_cum"), e), F.col("source")
        same_source = s.eqNullSafe(F.lit(cut["source"]))
        # Nulls come first in Spark's ascending order, as in the range sort above.
        before = F.coalesce(s < F.lit(cut["source"]), s.isNull() & F.lit(cut["source"] is not None), F.lit(False))
        tie = before | (same_source & (F.struct("_place", "size", F.lit(e)) <= F.struct(
            F.lit(cut["_place"]), F.lit(cut["size"]).cast("long"), F.lit(cut["e"]))))
        inside = (f < F.lit(cut["f"])) | ((f == F.lit(cut["f"])) & tie)
        return F.when((F.col("size") > 0) & (F.col("target") > 0) & inside, F.col("size")).otherwise(0).cast("long")

    epochs = [taken(e) for e in range(max_epochs)]
    whole = epochs[0]
    for e in epochs[1:]:
        whole = whole + e
    return queue.select(F.col("_key").alias(key), "size", "source_size", "target", whole.alias("taken"), *keep)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mixture itself: every document as often as it is taken, all columns kept."""
    narrow = docs.select(F.col(key).alias("_mix_key"), F.col(source).alias("_mix_source"), word_count(F.col(text)).alias("_mix_size"),
                         *row_key(docs, key))
    plan = schedule(narrow, "_mix_key", "_mix_source", F.col("_mix_size"), keep=tuple(KEYS), **options)
    # Repeated rows are one row here, taken as often as all of them together.
    times = plan.where("taken > 0").groupBy(*KEYS).agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("_times"))
    out = rows_of(docs, key, materialize(times, "mix-times-taken"), "_times")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_epoch")).select("_row.*")
