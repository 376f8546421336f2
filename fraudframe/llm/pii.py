"""Personal data with offset-preserving deobfuscation.

``email``, ``ip``, ``card`` (Luhn) and ``phone`` are found in the source text first.  Then three
small transducers rewrite the text and remember, for every run of output, the source run it came
from: lookalike letters and digits of other scripts become ASCII, spelled digits become digits,
disguised at and dot become ``@`` and ``.``.  The same detectors run on the rewritten text; what
they find across a rewritten run is mapped back to source positions and added, unless a
base span of its kind covers it.  Texts without a trigger are never rewritten.

Matches of a kind are leftmost and do not overlap; one that fails its check is dropped without a
retry.  All detectors take time linear in the text.

Defined results: null text is empty; a null id stays null; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored.  Spans are code points, end exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Letters and digits that look like the ASCII one they stand beside.
LOOKALIKES = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοα" "ЅІЈҮԌԚԜӀӏһѵѡɡıϹϲϳρνικυχγωσοսոօհց",
                      "ABEKMHOPCTXaeopcyxijsdqwABEZHIKMNOPTYXoa" "SIJYGQWIlhvwgiCcjpvikuxywoouno" "hg"))
# Spelled digits in the languages of the corpus.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
               "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
               "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
               "acht": "8", "neun": "9",
               "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
               "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
               "ocho": "8", "nueve": "9"}
#: Spelled digits in a row from which they are read as a number.
LEAST_SPELLED = 4

_HIDDEN = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_WIDE = "！-～٠-٩۰-۹०-९"
_MATHEMATICAL = "\U0001d400-\U0001d7ff\u24b6-\u24e9\u2102\u210a-\u2113\u2115\u2119-\u211d\u2124\u2128\u212a\u212c\u212d\u212f-\u2134"  # and circled letters, read by NFKC
_LOOKALIKE = re.compile(f"[{''.join(LOOKALIKES)}{_WIDE}{_MATHEMATICAL}]")
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_GAP = r"(?:[\x20,-]{1,2}|\x20(?:dot|point|punkt|punto)\x20)"
_SPELLED = re.compile(rf"(?<![^\W\d_])(?:plus\x20)?(?:{_WORDS})(?:{_GAP}(?:{_WORDS})){{{LEAST_SPELLED - 1},}}(?![^\W\d_])", re.I)
_SPELLED_PART = re.compile(rf"plus|dot|point|punkt|punto|{_WORDS}", re.I)
_MARKED = re.compile(r"\x20{0,2}[\[({<]\x20{0,2}(?:(at|arroba)|dot|punkt|point|punto)\x20{0,2}[\])}>]\x20{0,2}", re.I | re.A)
_ESCAPED = re.compile(r"(&#0*64;|&commat;|%40)|&#0*46;|&period;|%2e", re.I | re.A)
# Bare words.  A listed last part is enough for "at ... dot ..."; any other of two or more letters is taken too,
# unless the words read as prose: a determiner behind "at", or a function word as the last part.
_LAST = "com|org|net|edu|gov|info|biz|io|dev|app|ai|me|eu|de|fr|es|it|nl|uk|us|ca|au|ch|at|be|pl|ru|jp|cn|in|br|example|test"
_PROSE_FIRST = ("the|this|that|these|those|a|an|any|each|every|some|one|which|what|my|your|his|her|its|our|their|no|"
                "el|la|los|las|un|una|este|esta|ese|esa|le|les|une|ce|cette|der|die|das|dem|den|ein|eine")
_PROSE_LAST = ("here|there|is|was|are|on|and|or|the|that|this|to|of|for|with|as|where|when|which|but|then|if|so|by|from|"
               "que|en|el|la|los|las|del|con|por|para|donde|et|ou|le|les|des|und|oder|der|die|das|ist|wo")
# "at ... point ..." is common English ("at boiling point in"): only these.
_POINT_LAST = "com|org|net|edu|info|io|dev|app|eu|de|fr|ch|ca"
_LABEL, _END = "[A-Za-z0-9-]{1,63}", "(?![A-Za-z0-9-])"


def _tail(dots: str, last: str) -> str:
    return rf"{_LABEL}(?:\x20(?:{dots})\x20{_LABEL})*\x20(?:{dots})\x20{last}{_END}"


_ANY_LAST = f"(?!(?:{_PROSE_LAST}){_END})[A-Za-z]{{2,63}}"
_BARE = re.compile(
    r"(?<=[A-Za-z0-9])\x20(?:"
    rf"at\x20(?=(?!(?:{_PROSE_FIRST})\x20)(?:{_tail('dot|punkt|punto', _ANY_LAST)}|{_tail('dot|punkt|point|punto', f'(?:{_POINT_LAST})')})"
    rf"|{_tail('dot', f'(?:{_LAST})')})"
    rf"|arroba\x20(?={_tail('dot|punkt|point|punto', _ANY_LAST)}|{_tail('dot|punkt|point|punto', f'(?:{_LAST})')}))", re.A | re.I)
_BARE_DOT = re.compile(r"(?<=[A-Za-z0-9])\x20dot\x20(?=[A-Za-z0-9])", re.A | re.I)
# The words of other languages are common in prose, so only texts with a disguised at have theirs read.
_BARE_DOTS = re.compile(r"(?<=[A-Za-z0-9])\x20(?:dot|punkt|point|punto)\x20(?=[A-Za-z0-9])", re.A | re.I)


def emails(text: str):
    """Anchored at each @: what stands before it, as far left as allowed, and the domain behind."""
    used, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            used = m.end()
            yield start, used
        at = text.find("@", max(used, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    found = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(1 for _ in _DIGIT.finditer(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def _plain(c: str) -> str:
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    d = unicodedata.digit(c, None)
    if d is not None:
        return str(d)
    plain = unicodedata.normalize("NFKC", c)[:1] or c
    return LOOKALIKES.get(plain, plain)  # a mathematical alpha is an alpha first


class Rewritten:
    """A text and, run by run, the source positions it came from."""

    def __init__(self, text: str, runs=None):
        self.text = text
        #: (position here, end here, source start, source end, rewritten?)
        self.runs = runs or [(0, len(text), 0, len(text), False)]
        self._starts = [r[0] for r in self.runs]

    def source(self, start: int, end: int) -> tuple[int, int]:
        def at(p: int, last: bool) -> int:
            a, b, s, e, changed = self.runs[bisect_right(self._starts, p) - 1]
            if changed:
                return e if last else s
            return s + (p - a) + last
        return at(start, False), at(end - 1, True)

    def touched(self, start: int, end: int) -> bool:
        """Whether a rewritten run lies in the span, or something between was taken out."""
        s, e = self.source(start, end)
        first, last = bisect_right(self._starts, start) - 1, bisect_left(self._starts, end)
        return e - s != end - start or any(r[4] for r in self.runs[first:last])

    def apply(self, pattern: re.Pattern, to) -> Rewritten:
        """Replace every match; ``to`` gives the output, or the match's pieces as (start, end, output)."""
        pieces = []
        for m in pattern.finditer(self.text):
            out = to(m)
            pieces += [(m.start(), m.end(), out)] if isinstance(out, str) else out
        if not pieces:
            return self
        out, runs, size, at, k = [], [], 0, 0, 0

        def copy(a: int, b: int) -> None:
            nonlocal size, k
            while a < b:  # old runs within [a, b)
                while self.runs[k][1] <= a:
                    k += 1
                ra, rb, s, e, changed = self.runs[k]
                stop = min(b, rb)
                src = (s, e) if changed else (s + a - ra, s + stop - ra)
                runs.append((size, size + stop - a, *src, changed))
                out.append(self.text[a:stop])
                size += stop - a
                a = stop
        for a, b, new in pieces:
            copy(at, a)
            if new:
                src = self.source(a, b)
                runs.append((size, size + len(new), *src, True))
                out.append(new)
                size += len(new)
            at = b
        copy(at, len(self.text))
        return Rewritten("".join(out), runs)


@cache
def _digit_automaton():
    import ahocorasick
    a = ahocorasick.Automaton()
    for w in DIGIT_WORDS:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


def _may_spell(text: str) -> bool:
    """Whether enough digit words follow each other closely; the expression is only tried then."""
    near: list[tuple[int, int]] = []  # (end, words in the chain up to here) of the latest hits
    for last, n in _digit_automaton().iter(text.lower()):
        start, chain = last - n + 1, 1
        near = [x for x in near if last - x[0] <= 24]
        for end, length in near:
            if 1 <= start - end <= 8 and length >= chain:
                chain = length + 1
        if chain >= LEAST_SPELLED:
            return True
        near.append((last + 1, chain))
    return False


def _spelled(m: re.Match) -> list[tuple[int, int, str]]:
    words = list(_SPELLED_PART.finditer(m.string, m.start(), m.end()))
    ends = [w.start() for w in words[1:]] + [m.end()]
    out, at = [], m.start()
    for w, end in zip(words, ends):
        word = w[0].lower()
        new = DIGIT_WORDS.get(word) or ("+" if word == "plus" else ".")
        # The gaps between words go with the word before; a dot takes the gap before it too.
        out.append((at, end, new))
        at = end
    return out


def deobfuscate(text: str) -> Rewritten:
    """The composed transducers: lookalikes, then spelled digits, then at and dot."""
    r = Rewritten(text)
    if not text.isascii():
        r = r.apply(_HIDDEN, lambda m: "")
        r = r.apply(_LOOKALIKE, lambda m: _plain(m[0]))
    if _may_spell(r.text):
        r = r.apply(_SPELLED, _spelled)
    r = r.apply(_MARKED, lambda m: "@" if m[1] else ".")
    if "&" in r.text or "%" in r.text:
        r = r.apply(_ESCAPED, lambda m: "@" if m[1] else ".")
    bare = r.apply(_BARE, lambda m: "@")
    if bare is not r or r.text.count("@") > text.count("@"):
        r = bare.apply(_BARE_DOTS, lambda m: ".")
    elif "@" in r.text:
        r = r.apply(_BARE_DOT, lambda m: ".")
    return r


def find_pii(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), both by kind as listed, then start."""
    text = text or ""
    base = detect(text)
    r = deobfuscate(text)
    if r.text == text:
        return base, base
    used = {k: sorted((a, b) for kind, a, b in base if kind == k) for k in KINDS}
    added = []
    for kind, a, b in detect(r.text):
        if r.touched(a, b):
            s, e = r.source(a, b)
            if not any(x <= s and e <= y for x, y in used[kind]):
                added.append((kind, s, e))
    return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


RESULT = "struct<base:array<struct<kind:string,start:int,end:int>>,found:array<struct<kind:string,start:int,end:int>>>"


def _rows(found) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in found]


def spans(text: Column) -> Column:
    """``base`` and ``found`` (base and added) spans of a text."""
    @F.pandas_udf(RESULT)
    def pii_spans(s: pd.Series) -> pd.DataFrame:
        both = [find_pii(t) for t in s]
        return pd.DataFrame({"base": [_rows(b) for b, _ in both], "found": [_rows(f) for _, f in both]})
    return pii_spans(text)


def scan(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row: key, ``base`` and ``found``."""
    return small_batches(df).select(F.col(key), spans(F.col(text)).alias("_pii")).select(key, "_pii.base", "_pii.found")
