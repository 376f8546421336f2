"""Toxicity by a weighted finite-state pattern grammar.

Terminals.  Insults are a learned lexicon: whole words and word beginnings (``stem*``) whose toxic
share is beyond chance (a Chernoff bound of one in a million), counted by Spark over labelled
training rows; a pattern's strength grows with its log-odds (less one standard error) up to 1 at ``SURE``.  A
beginning goes where a longer pattern explains most of its hits.
Threat verbs, second persons, negations and speech verbs are short fixed lists.

Grammar.  Words become symbols, and three small transducers, each a transition table, read them: negation (a window
of a few words behind a negating one), reported speech (from a speech verb to the end of the sentence, or
within quotation marks over sentences) and target (a second person a few words before a match or, guessed
by a second path that dies if none comes, behind it).  Their product is the grammar; the weight of a match is that of its
kind and of what the three say about it (``WEIGHTS``), and a sentence weighs what its best path does.  So the same insult
weighs more aimed at a person than alone, less reported, least negated, and a threat weighs nothing without a person.

Score.  A text's total is its heaviest sentence and a little for the rest; the score is a logistic function of it.  Training
only places and stretches that function within bounds (``MIDDLES``, ``SLOPES``) that keep one aimed insult or
threat at 0.5 or more and one reported or negated below; every training row is read with a lexicon that leaves its fold out.

Training rows are at most ``fit_rows`` labelled ids (smallest hashes), one row each, whose
crc32(id) mod 5 is not 0; a lexicon of more than ``lexicon_size`` patterns is an error.  Scoring reads every text whole.

Defined results: null and empty texts get the score of no match; a null id counts as the empty
text in the hold-out rule and is never trained on; repeated labels of an id count as toxic if
any is; without training rows of both classes the score is the training share (0 if
none); repeated rows get equal scores; an empty table gives an empty result; other columns are
ignored by :func:`score` and kept by :func:`keep_clean`.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import small_batches

FIT_ROWS = 20_000
LEXICON_SIZE = 20_000
FOLDS = 5
#: Natural log of the odds against chance that a pattern must have, and of the hits a longer pattern must explain.
SIGNIFICANCE = 14.0
EXPLAINED = 0.8
PREFIXES = (4, 5, 6)

# The grammar's closed word classes in the four languages of the corpus.
THREATS = frozenset(
    "kill kills killing hurt hurts hurting beat beats beating stab stabs stabbing shoot shoots shooting destroy destroys destroying "
    "töten töte tötet umbringen umbringe umbringt schlagen schlage schlägt erschießen erschieße "
    "tuer tue tuerai tuera frapper frappe frapperai frappera "
    "matar mato mataré matará matarte matarlos golpear golpeo golpearé golpeará golpearte".split())
TARGETS = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti "
                    "usted vosotros eres".split())
NEGATIONS = frozenset("not no never isn aren wasn don doesn didn nicht kein keine nie pas jamais ne nunca".split())
REPORTS = frozenset("said says say called calls quote quoted wrote reported sagte schrieb nannte dit disait écrit "
                    "dijo llamó escribió".split())
#: Threat verbs that hold their target: the verb itself names a second person.
HELD = frozenset("matarte golpearte".split())

NEGATION_REACH = 3
TARGET_REACH = 4
_TOKEN = re.compile(r"[^\W\d_]+|[\"“”«»]|[,;:]|[.!?…]+|\n")
MATCHES = ("insult", "threat", "held")
SYMBOLS = (*MATCHES, "person", "negation", "report", "quote", "break", "stop", "line", "word")
#: Weight of a match by kind, whether it is negated, reported, targeted.
WEIGHTS = {(kind, n, r, t): w for kind, alone in (("insult", 0.6), ("threat", 0.0)) for t in (False, True) for n, r, w in (
    (False, False, 1.0 if t else alone), (False, True, 0.25 if t or alone else 0.0),
    (True, False, 0.1 if t or alone else 0.0), (True, True, 0.1 if t or alone else 0.0))}
#: Log-odds from which a pattern has its full strength.
SURE = 4.0
REST = 0.3
#: Where the score may be 0.5, and how steep it may be there.
MIDDLES = tuple(x / 100 for x in range(35, 81, 5))
SLOPES = (3.0, 4.0, 6.0, 8.0, 11.0, 15.0, 20.0)

Table = dict  # (state, symbol) -> ((next state, output), ...); no entry: the path dies


def negation_table() -> Table:
    """States: words left in the window.  Output: whether the symbol is negated."""
    out = {}
    for left in range(NEGATION_REACH + 1):
        for s in SYMBOLS:
            after = NEGATION_REACH if s == "negation" else 0 if s in ("break", "stop", "line") else max(0, left - 1)
            out[left, s] = ((after, left > 0),)
    return out


def report_table() -> Table:
    """States: (a speech verb in this sentence, within quotation marks).  Output: whether the symbol is reported."""
    out = {}
    for speech in (False, True):
        for quoted in (False, True):
            for s in SYMBOLS:
                after = (speech, quoted)
                if s == "report":
                    after = (True, quoted)
                elif s == "quote":
                    after = (False, False) if quoted else (speech, True)
                elif s == "stop":
                    after = (speech and quoted, quoted)
                elif s == "line":
                    after = (False, False)
                out[(speech, quoted), s] = ((after, speech or quoted),)
    return out


def target_table() -> Table:
    """States: words a person may still be behind ("seen"), or words until one must have come ("wait").  Output: whether aimed."""
    none, out = ("none", 0), {}
    states = [none, *[("seen", n) for n in range(1, TARGET_REACH + 1)], *[("wait", n) for n in range(TARGET_REACH)]]
    for state in states:
        kind, left = state
        # One word further: a person seen too long ago is forgotten, one waited for too long never came.
        step = none if kind == "none" or state == ("seen", 1) else (kind, left - 1) if left else None
        for s in SYMBOLS:
            if s == "person":
                ways = ((("seen", TARGET_REACH), False),)
            elif s in ("stop", "line"):
                ways = () if kind == "wait" else ((none, False),)
            elif step is None:
                ways = ()
            elif s == "held" or (s in MATCHES and kind != "none"):
                ways = ((step, True),)
            elif s in MATCHES:
                ways = ((none, False), (("wait", TARGET_REACH - 1), True))
            else:
                ways = ((step, False),)
            if ways:
                out[state, s] = ways
    return out


START = (0, (False, False), ("none", 0))


def compose(*tables: Table) -> Table:
    """The product: all read the same symbol, outputs are put together."""
    out, states = {}, [START]
    known = {START}
    while states:
        state = states.pop()
        for s in SYMBOLS:
            ways = [()]
            for part, table in zip(state, tables):
                ways = [w + (x,) for w in ways for x in table.get((part, s), ())]
            if ways:
                out[state, s] = tuple((tuple(n for n, _ in w), tuple(o for _, o in w)) for w in ways)
                for w in ways:
                    after = tuple(n for n, _ in w)
                    if after not in known:
                        known.add(after)
                        states.append(after)
    return out


@cache
def grammar_table() -> Table:
    return compose(negation_table(), report_table(), target_table())


def symbol(word: str) -> str:
    if word in HELD:
        return "held"
    for words, name in ((THREATS, "threat"), (TARGETS, "person"), (NEGATIONS, "negation"), (REPORTS, "report")):
        if word in words:
            return name
    if word[0].isalpha():
        return "word"
    return "quote" if word in '"“”«»' else "break" if word in ",;:" else "line" if word == "\n" else "stop"


def weigh(symbols: list[tuple[str, float]], table: Table | None = None) -> list[float]:
    """The weights of the sentences of one line: symbols with the strength of their match (1 for threats)."""
    table = grammar_table() if table is None else table
    out = []
    paths = {START: 0.0}  # state -> weight of the best path since the sentence began
    for s, strength in [*symbols, ("line", 0.0)]:
        after: dict = {}
        for state, weight in paths.items():
            for there, (negated, reported, aimed) in table.get((state, s), ()):
                w = weight
                if strength and s in MATCHES:
                    w += strength * WEIGHTS["insult" if s == "insult" else "threat", negated, reported, aimed]
                if w > after.get(there, -1.0):
                    after[there] = w
        paths = after
        if s in ("stop", "line"):
            best = max(paths.values())  # a guess has its alternative, so some path is always left
            if best:
                out.append(best)
            paths = dict.fromkeys(paths, 0.0)
    return out


def total(sentences: list[float]) -> float:
    if not sentences:
        return 0.0
    heaviest = max(sentences)
    return heaviest + REST * math.log1p(sum(sentences) - heaviest)


@dataclass
class Grammar:
    """Insult patterns with log-odds (``stem*`` for beginnings) and the place and slope of the score.

    ``share`` replaces the score where nothing could be learned.
    """

    weights: dict[str, float]
    middle: float = 0.5
    slope: float = 8.0
    share: float | None = None

    def __getstate__(self):
        return {"weights": self.weights, "middle": self.middle, "slope": self.slope, "share": self.share}

    @cached_property
    def automaton(self):
        import ahocorasick
        a = ahocorasick.Automaton()
        stems: dict[str, dict[str, float]] = {}
        for p, w in self.weights.items():
            stems.setdefault(p.rstrip("*"), {})["stem" if p.endswith("*") else "word"] = w
        for t in THREATS:
            stems.setdefault(t, {}).setdefault("word", 0.0)
        for s, kinds in stems.items():
            a.add_word(s, (len(s), kinds.get("word"), kinds.get("stem")))
        a.make_automaton()
        return a

    def total(self, text: str | None) -> float:
        low = (text or "").lower()
        hits: dict[int, float] = {}
        for end, (n, word, stem) in self.automaton.iter(low):
            start = end - n + 1
            if start and low[start - 1].isalpha():
                continue
            whole = end + 1 == len(low) or not low[end + 1].isalpha()
            weight = max(x for x in (word if whole else None, stem, -1.0) if x is not None)
            if weight >= 0:
                hits[start] = max(hits.get(start, 0.0), weight)
        sentences: list[float] = []
        done = -1
        for at in sorted(hits):  # only lines with a match are read
            if at < done:
                continue
            begin, done = low.rfind("\n", 0, at) + 1, low.find("\n", at)
            done = len(low) if done < 0 else done
            line = []
            for m in _TOKEN.finditer(low, begin, done):
                strength = min(1.0, hits.get(m.start(), 0.0) / SURE)
                name = "insult" if strength > 0 else symbol(m[0])
                line.append((name, strength if name == "insult" else 1.0))
            sentences += weigh(line)
        return total(sentences)

    def score(self, text: str | None) -> float:
        if self.share is not None:
            return self.share
        return 1.0 / (1.0 + math.exp(-self.slope * (self.total(text) - self.middle)))


def held_out_remainder(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, text: str, key: str, fit_rows: int) -> DataFrame:
    """At most ``fit_rows`` labelled (id, text, fold, toxic) rows outside the hold-out, one for each id."""
    marks = (labels.select(F.col(key).alias("_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("_id is not null and toxic is not null").groupBy("_id").agg(F.max("toxic").alias("toxic")))
    marks = marks.withColumn("fold", held_out_remainder("_id")).where("fold <> 0")
    marks = marks.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The sample is bounded by fit_rows (a few hundred KB), so it is broadcast; texts are not moved.
    met = rows.join(F.broadcast(marks), rows["_key"] == marks["_id"])
    return met.groupBy("_id").agg(F.min("text").alias("text"), F.first("fold").alias("fold"), F.first("toxic").alias("toxic"))


def _patterns(text: Column) -> Column:
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))
    return F.array_distinct(F.concat(words, *[_stems(words, n) for n in PREFIXES]))


def _stems(words: Column, n: int) -> Column:
    longer = F.filter(words, lambda w: F.length(w) > n)
    return F.transform(longer, lambda w: F.concat(F.left(w, F.lit(n)), F.lit("*")))


def _weight(hits: float, misses: float, prior: float) -> float:
    """Log-odds of toxic given the pattern, against the prior odds, less one standard error."""
    odds = math.log((hits + 0.5) / (misses + 0.5)) - prior
    return odds - math.sqrt(1 / (hits + 0.5) + 1 / (misses + 0.5))


def _against_chance(hits: Column, n: Column, rate: float) -> Column:
    """Chernoff exponent of at least ``hits`` toxic rows among ``n`` at the base rate (0 below the rate)."""
    share = hits / n
    exponent = hits * F.ln(share / rate) + F.when(hits < n, (n - hits) * F.ln((1 - share) / (1 - rate))).otherwise(0.0)
    return F.when((hits > 0) & (share > rate), exponent).otherwise(0.0)


def _irreducible(hits: dict[str, int]) -> list[str]:
    """Without the beginnings of which one longer pattern explains most hits."""
    ordered = sorted((p.rstrip("*"), p) for p in hits)
    out = []
    for i, (stem, p) in enumerate(ordered):
        keep = True
        for other, q in ordered[i + 1:] if p.endswith("*") else ():
            if not other.startswith(stem):
                break
            if q != p and (len(other) > len(stem) or not q.endswith("*")) and hits[q] >= EXPLAINED * hits[p]:
                keep = False
                break
        if keep:
            out.append(p)
    return out


def place_score(totals: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The middle and slope within the bounds with the least log-loss (ties: the first)."""
    best = None
    for middle in MIDDLES:
        for slope in SLOPES:
            z = slope * (totals - middle)
            loss = float((np.logaddexp(0, z) - toxic * z).sum())
            if best is None or loss < best[0] - 1e-9:
                best = (loss, middle, slope)
    return best[1], best[2]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", fit_rows: int = FIT_ROWS,
        lexicon_size: int = LEXICON_SIZE) -> Grammar:
    """Learn lexicon and coefficients; only bounded tables reach the driver."""
    # The bounded sample is written once; the documents are not scanned again for it.
    rows = materialize(training_rows(docs, labels, text, key, fit_rows), "toxicity-training")
    folds = range(1, FOLDS)
    sizes = {(r["fold"], r["toxic"]): r["n"]
             for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = (sum(n for (_, t), n in sizes.items() if t == v) for v in (1, 0))
    if not toxic or not clean:
        return Grammar({}, share=toxic / max(1, toxic + clean))

    counted = rows.select("fold", "toxic", F.explode(_patterns(F.col("text"))).alias("pattern"))
    columns = [F.count_if((F.col("fold") == f) & (F.col("toxic") == v)).alias(f"n{f}{v}") for f in folds for v in (0, 1)]
    counts = counted.groupBy("pattern").agg(*columns)
    hits = sum((F.col(f"n{f}1") for f in folds), F.lit(0))
    misses = sum((F.col(f"n{f}0") for f in folds), F.lit(0))
    strength = _against_chance(hits, hits + misses, toxic / (toxic + clean))
    best = {r["pattern"]: r for r in counts.withColumn("strength", strength).where(F.col("strength") > SIGNIFICANCE)
            .limit(lexicon_size + 1).collect()}
    if len(best) > lexicon_size:
        raise ValueError(f"more than {lexicon_size} patterns are beyond chance: raise lexicon_size")
    best = [best[p] for p in _irreducible({p: sum(r[f"n{f}1"] for f in folds) for p, r in best.items()})]

    def lexicon(without: int | None) -> dict[str, float]:
        used = [f for f in folds if f != without]
        pos, neg = (sum(sizes.get((f, v), 0) for f in used) for v in (1, 0))
        base = math.log((pos + 0.5) / (neg + 0.5))
        out = {}
        for r in best:
            w = _weight(sum(r[f"n{f}1"] for f in used), sum(r[f"n{f}0"] for f in used), base)
            if w > 0.1:
                out[r["pattern"]] = w
        return out

    # Every training row is read with the lexicon that leaves its own fold out.
    by_fold = {f: Grammar(lexicon(f)) for f in folds}

    @F.pandas_udf("double")
    def fold_total(texts: pd.Series, fold: pd.Series) -> pd.Series:
        return pd.Series([by_fold[f].total(t) for t, f in zip(texts, fold)], dtype="float64")

    got = small_batches(rows).select("toxic", fold_total("text", "fold").alias("x")).collect()
    middle, slope = place_score(np.array([r["x"] for r in got], float), np.array([r["toxic"] for r in got], float))
    return Grammar(lexicon(None), middle, slope)


def score_column(text: Column, grammar: Grammar) -> Column:
    @F.pandas_udf("double")
    def toxicity(s: pd.Series) -> pd.Series:
        return pd.Series([grammar.score(t) for t in s], dtype="float64")
    return toxicity(text)


def score(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", grammar: Grammar | None = None,
          **options) -> DataFrame:
    """One row per document: key, held_out, score, predicted."""
    grammar = grammar or fit(docs, labels, text, key, **options)
    out = small_batches(docs).select(F.col(key), (held_out_remainder(key) == 0).alias("held_out"),
                                     score_column(F.col(text), grammar).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows that are not predicted toxic, all columns kept."""
    grammar = fit(docs, labels, text, key, **options)
    columns = docs.columns
    scored = small_batches(docs).withColumn("_toxicity", score_column(F.col(text), grammar))
    return scored.where(F.col("_toxicity") < 0.5).select(*columns)
