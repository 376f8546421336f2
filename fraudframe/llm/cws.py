"""Document fingerprints by consistent weighted sampling (DataFrame functions only).

A text is a weighted set: its words (A-Z lowered) with their counts.  For each of ``samples``
independent samples, a term of weight S draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash:

    t = floor(ln S / r + b),   ln y = r (t - b),   ln a = ln c - ln y - r

and the term with the smallest a is sampled, together with t.  Two texts agree in a sample with a
probability equal to their generalised Jaccard similarity, sum min / sum max of the weights; the
share of equal samples estimates it.

The draws come from three uniform numbers and two exponential ones, e and f, so that most need no logarithm:
c = e + f, u1 = e / c (uniform, and independent of c), r = -ln(u1 u2), b = ln(u2) / ln(u1 u2).  Then
a = c u1 (u1 u2)^t = e (u1 u2)^t, and t >= 1 only if S u1 >= 1.  A word that comes once has t = 0 and a = e: its place
among the others is 1 - exp(-a), a hash as it is.  Places are 62-bit numbers, a sample is their plain minimum in
generated code, kept as 32 bits of its hash; unequal samples agree by accident once in 4 billion.

Words are counted inside their row (sorted hashes, runs), so no word is shuffled; the aggregate holds one row per
text and block of LANES samples.  Texts move once, to the partition of their key, and the half of each that the
document before needs once more; both moves are shared by all that follows.

Defined results: null text is empty; a text without words has the fingerprint of dashes, which is like itself
and nothing else; a null id stays null and sorts last; rows with equal id are ordered by text, and
rows equal in both get equal results; the document after the last is the first; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import with_pid

SAMPLES = 64
#: Samples side by side in a row, and those of a repeated word: with more, the generated code is too long to be compiled.
LANES, PART = 16, 2
EMPTY = "-"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = "[\\x20\\x09-\\x0D]+"
#: Above every place.
ABSENT = (1 << 63) - 1
_SCALE = float(1 << 62)
_STEP = 1.0 / (1 << 32)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where lambdas refer to it."""
    return F.transform(F.array(value), use)[0]


def _terms(text: Column, side: int) -> Column:
    """An array of (side, term: hash of a word, n: how often the text has it)."""
    words = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPACE), "")

    def runs(h: Column) -> Column:
        # Without words the places are 0 and -1, where nothing follows nothing.
        starts = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: ~F.get(h, i).eqNullSafe(F.get(h, i - 1)))
        return _bound(starts, lambda s: F.transform(s, lambda i, j: F.struct(
            F.lit(side).alias("side"), F.get(h, i).alias("term"), (F.coalesce(F.get(s, j + 1), F.size(h)) - i).alias("n"))))

    return _bound(F.sort_array(F.transform(words, lambda w: F.xxhash64(w))), runs)


def _if(condition: Column, value: Column) -> Column:
    """The value, never null (shorter code), and 0 without taking it where the condition does not hold."""
    return F.when(condition, F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))


def _places(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep and ``_s0``, ``_s1``...: the place of the sample of ``_term`` in each lane of its ``_block``.

    A single word fills all lanes of its row, a repeated one those of its ``_part`` (the others are ABSENT).
    Steps stand in selects of their own, so that no logarithm is taken twice, and none for single words.
    """
    lanes, many = range(PART), F.col("_n") > 1
    first = F.col("_block") * LANES + F.col("_part") * PART
    rows = rows.select(*keep, "_n", "_part", *[F.xxhash64("_term", first + j).alias(f"_h{j}") for j in range(LANES)])
    place = [F.shiftrightunsigned(f"_h{j}", 2) for j in range(LANES)]
    more = [F.xxhash64(f"_h{j}") for j in lanes]
    v = [F.least((place[j].cast("double") + 0.5) * (1.0 / _SCALE), F.lit(1.0 - 2.0 ** -53)) for j in lanes]
    u = [[(bits.cast("double") + 0.5) * _STEP for bits in (F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF)))] for x in more]
    rows = rows.select("*", *[_if(many, -F.log1p(-v[j])).alias(f"_e{j}") for j in lanes], *[_if(many, -F.ln(u[j][0])).alias(f"_f{j}") for j in lanes])
    e, f, r, t = [[F.col(f"_{c}{j}") for j in lanes] for c in "efrt"]
    # t >= 1 if n >= 1 / u1 = (e + f) / e.
    rows = rows.select("*", *[_if(many & (e[j] * (F.col("_n") - 1) >= f[j]), -F.ln(e[j] / (e[j] + f[j]) * u[j][1])).alias(f"_r{j}") for j in lanes])
    rows = rows.select("*", *[_if(r[j] > 0, F.floor(F.ln(F.col("_n") / u[j][1]) / r[j]).cast("double")).alias(f"_t{j}") for j in lanes])
    a = [e[j] * F.exp(-r[j] * t[j]) for j in lanes]
    later = [F.coalesce((-F.expm1(-a[j]) * _SCALE).cast("long"), F.lit(0)) for j in lanes]
    rows = rows.select(*keep, "_n", "_part", *[f"_h{j}" for j in range(LANES)],
                       *[F.when(t[j] > 0, later[j]).otherwise(place[j]).alias(f"_p{j}") for j in lanes])
    return rows.select(*keep, *[F.when(~many, place[j]).when(F.col("_part") == j // PART, F.col(f"_p{j % PART}")).otherwise(ABSENT).alias(f"_s{j}")
                                for j in range(LANES)])


def signatures(texts: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """keys, ``signature`` (array of ints) for every text with words."""
    return side_signatures(texts, keys, {"signature": F.col(text)}, samples)


def _whole(side: int, samples: int) -> Column:
    """A side's blocks of ``_bs`` as one array; null without any."""
    own = F.filter("_bs", lambda b: b["_side"] == side)
    return F.when(F.size(own) > 0, F.slice(F.flatten(F.transform(own, lambda b: b["lanes"])), 1, samples))


def side_signatures(texts: DataFrame, keys: list[str], sides: dict[str, Column], samples: int = SAMPLES) -> DataFrame:
    """keys and one signature (array of ints, null without words) per text of ``sides``, for rows with any words."""
    some = F.lit(False)
    for name in sides:
        some = some | F.col(name).isNotNull()
    # Keys may repeat: a row is told by its texts too, and equal ones are counted.
    chosen = texts.select(*keys, *[F.coalesce(c, F.lit("")).alias(n) for n, c in sides.items()])
    told = chosen.groupBy(*keys, F.xxhash64(*sides).alias("_th")).agg(*[F.first(n).alias(n) for n in sides], F.count(F.lit(1)).alias("_copies"))
    signed = _with_signatures(told, [*keys, "_th", "_copies"], {n: F.col(n) for n in sides}, samples).where(some)
    return signed.select(*keys, *sides, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")).drop("_copy")


def _with_signatures(rows: DataFrame, keep: list[str], sides: dict[str, Column], samples: int) -> DataFrame:
    """The ``keep`` columns (distinct) and one signature per text of ``sides``.

    Where ``rows`` is partitioned by some of its ``keep`` columns already, this adds no shuffle.
    """
    terms = rows.select(*keep, F.explode_outer(F.concat(*[_terms(c, i) for i, c in enumerate(sides.values())])).alias("_t"))
    terms = terms.select(*keep, *[F.coalesce(F.col(f"_t.{c}"), F.lit(-1)).alias(f"_{c}") for c in ("side", "term", "n")])
    blocks, parts = -(-samples // LANES), LANES // PART
    rounds = F.when(F.col("_n") > 1, F.sequence(F.lit(0), F.lit(blocks * parts - 1))).otherwise(F.sequence(F.lit(0), F.lit((blocks - 1) * parts), F.lit(parts)))
    terms = terms.select("*", F.explode(rounds).alias("_round"))
    terms = terms.select(*keep, "_side", "_term", "_n", F.expr(f"_round div {parts}").cast("int").alias("_block"), (F.col("_round") % parts).alias("_part"))
    placed = _places(terms, [*keep, "_side", "_block"])
    blocks = placed.groupBy(*keep, "_side", "_block").agg(*[F.min(f"_s{j}").alias(f"_m{j}") for j in range(LANES)])
    lanes = F.array(*[(F.xxhash64(f"_m{j}").bitwiseAND(F.lit(0xFFFFFFFF)) - (1 << 31)).cast("int") for j in range(LANES)])
    blocks = blocks.select(*keep, F.struct("_side", "_block", lanes.alias("lanes")).alias("_b"))
    in_order = blocks.groupBy(*keep).agg(F.array_sort(F.collect_list("_b")).alias("_bs"))
    return in_order.select(*keep, *[_whole(i, samples).alias(name) for i, name in enumerate(sides)])


def fingerprint(signature: Column) -> Column:
    """Eight hex digits per sample."""
    digits = F.transform(signature, lambda x: F.lpad(F.hex(x.cast("long") + (1 << 31)), 8, "0"))
    return F.coalesce(F.lower(F.array_join(digits, "")), F.lit(EMPTY))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples; two texts without words are alike."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / float(samples)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


KEY = ["kid", "nul", "th"]  # a row's place in the order: id (0 if null), whether it is null, hash of the text
ORDER = ["nul", "kid", "th"]


def _successors(rows: DataFrame) -> DataFrame:
    """KEY and n of distinct rows -> the same, ``next`` and ``before`` (KEY, n) in id order, around."""
    ranged = with_pid(rows, [F.col(c) for c in ORDER], "cws-order")
    inside = Window.partitionBy("_pid").orderBy(*ORDER)
    here, place = F.struct(*KEY, "n"), F.struct(*ORDER)
    ranged = ranged.withColumns({"next": F.lead(here).over(inside), "before": F.lag(here).over(inside)})
    # First and last row of each partition (one row per partition) close the gaps and the circle.
    ends = ranged.groupBy("_pid").agg(F.min_by(here, place).alias("first"), F.max_by(here, place).alias("last"))
    by_pid, everything = Window.orderBy("_pid"), Window.partitionBy()
    ends = ends.select(
        F.col("_pid").alias("_p"),
        F.coalesce(F.lead("first").over(by_pid), F.min_by("first", "_pid").over(everything)).alias("after"),
        F.coalesce(F.lag("last").over(by_pid), F.max_by("last", "_pid").over(everything)).alias("ahead"))
    joined = ranged.join(ends, F.col("_pid") == F.col("_p"))
    return joined.select(*KEY, F.coalesce("next", "after").alias("next"), F.coalesce("before", "ahead").alias("before"))


def neighbour_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", samples: int = SAMPLES) -> DataFrame:
    """One row per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by the beginning of the next document.
    """
    kind, body = dict(docs.dtypes)[key], F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key), F.lit(0).cast(kind)).alias("kid"), F.col(key).isNull().alias("nul"),
                       F.xxhash64(body).alias("th"), body.alias("text"))
    distinct = rows.select(*KEY, F.length("text").alias("n")).distinct()
    order = materialize(_successors(distinct), "cws-next")

    at = order.select(*[F.col(c).alias(f"_{c}") for c in KEY], F.struct(*[f"next.{c}" for c in KEY]).alias("next"),
                      F.struct(*[f"before.{c}" for c in KEY]).alias("to"), F.expr("before.n div 2").alias("lent"))
    mine = (F.col("kid") == F.col("_kid")) & (F.col("nul") == F.col("_nul")) & (F.col("th") == F.col("_th"))
    placed = rows.join(at, mine)
    # Only what the document before needs of this text is sent to it.
    lent = placed.select(*[F.col(f"to.{c}").alias(f"_{c}") for c in KEY], F.left("text", F.col("lent")).alias("head"))
    lent = lent.groupBy("_kid", "_nul", "_th").agg(F.first("head").alias("head"))
    pairs = placed.select(*KEY, "text", "next").join(lent, mine).groupBy(*KEY).agg(
        F.first("text").alias("text"), F.first("head").alias("head"), F.first("next").alias("next"), F.count(F.lit(1)).alias("copies"))
    n = F.length("text")
    edited = F.concat(F.left("text", n - F.expr("length(text) div 2")), F.col("head"))

    # Only the narrow keys go through the samples' aggregates.
    signed = _with_signatures(pairs.select(*KEY, "text", edited.alias("edited")), KEY, {"own": F.col("text"), "edit": F.col("edited")}, samples)
    signed = signed.select(*[F.col(c).alias(f"_{c}") for c in KEY], "own", "edit")
    facts = pairs.select(*KEY, "next", "copies", n.cast("long").alias("n_chars"), F.unhex(F.sha2(edited.cast("binary"), 256)).alias("sha"))
    done = materialize(facts.join(signed, mine).drop("_kid", "_nul", "_th"), "cws-signatures")

    following = done.select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("own").alias("other"))
    behind = (F.col("next.kid") == F.col("_kid")) & (F.col("next.nul") == F.col("_nul")) & (F.col("next.th") == F.col("_th"))
    out = done.join(following, behind).select(
        F.when(~F.col("nul"), F.col("kid")).alias(key), "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit"), samples).alias("near_edited"),
        likeness(F.col("own"), F.col("other"), samples).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    return out.drop("_copy")
