"""Secret scans: keyword automaton, anchored expressions near its hits, checksums.

One Aho-Corasick pass over the text (A-Z lowered, so positions stay) finds where a secret may
begin; only there the kind's expression is matched, anchored, and its check is applied:

* ``assign``  password / passwd / secret / token / api key assignments with a value of 12+ characters
* ``access``  ``AKIA`` access key ids of 18+ characters
* ``hex``     runs of 16+ lowercase hex digits; they have no literal keyword, so the automaton's
  part is taken by a search for 16 marks in the text mapped to its character classes
* ``forge``, ``package``  ``gh?_`` and ``npm_`` tokens whose last six characters are the base-62
  CRC-32 of the 30 before them
* ``jwt``     ``eyJ...`` tokens whose header decodes to JSON that names an algorithm

Matches of a kind are leftmost and do not overlap; a match that fails its check still uses up
its text, as a plain scan would.  The last three kinds are added by the method and never change
the first three.

Defined results: null text is empty; a null id stays null; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored by :func:`scan` and kept by
:func:`redact`.  Spans are code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "forge", "package", "jwt")
MARK = "[REDACTED]"

# Keywords by kind, and what is matched where one begins.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "forge": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "package": ("npm_",),
    "jwt": ("eyj",),
}
_ANY_CASE = {w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
             for w in ("password", "passwd", "secret", "token")}
_API_KEY = "[aA][pP][iI]_?[kK][eE][yY]"
PATTERNS = {
    "assign": re.compile(f"(?:{'|'.join([*_ANY_CASE.values(), _API_KEY])})"
                         r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
    "forge": re.compile("gh[oprsu]_[A-Za-z0-9]+"),
    "package": re.compile("npm_[A-Za-z0-9]+"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
}
_RUN = re.compile("[A-Za-z0-9_-]*")
HEX_RUN = 16
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_CLASSES = bytes(104 if chr(c) in "0123456789abcdef" else 46 for c in range(256))
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def token_checksum(body: str) -> str:
    """Base-62 CRC-32 of ``body``, six characters."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out.rjust(6, "0")


def _checksummed(m: re.Match) -> bool:
    body = m[0][4:]
    return len(body) == 36 and token_checksum(body[:30]) == body[30:]


def _names_algorithm(m: re.Match) -> bool:
    header = m[0].split(".", 1)[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(header + "=" * (-len(header) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(found, dict) and "alg" in found


CHECKS = {
    "assign": lambda m: len(m[1]) >= 12,
    "access": lambda m: len(m[0]) >= 18,
    "hex": lambda m: len(m[0]) >= HEX_RUN,
    "forge": _checksummed,
    "package": _checksummed,
    "jwt": _names_algorithm,
}


@cache
def _automaton():
    import ahocorasick
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    if text.isascii():
        return text.lower()
    return text.translate(_LOWER)


def _hits(text: str) -> Iterator[tuple[str, int]]:
    """(kind, position) where a secret may begin, ascending within a kind."""
    for end, (kind, n) in _automaton().iter(_lower(text)):
        yield kind, end - n + 1
    classes = text.encode("latin-1", "replace").translate(_CLASSES)
    run = b"h" * HEX_RUN
    at = classes.find(run)
    while at >= 0:
        yield "hex", at
        end = classes.find(b".", at)
        at = classes.find(run, end) if end >= 0 else -1


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found, used = [], {}
    for kind, at in _hits(text or ""):
        if at < used.get(kind, 0):
            continue
        m = PATTERNS[kind].match(text, at)
        if m:
            used[kind] = m.end()
            if CHECKS[kind](m):
                found.append((m.start(), m.end(), kind))
        elif kind == "jwt":  # no hit in the same run can end otherwise
            used[kind] = _RUN.match(text, at).end()
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact_text(text: str | None) -> str | None:
    """The text with every secret replaced; overlapping spans are one."""
    if not text:
        return text
    out, at = [], 0
    for start, end, _ in find_secrets(text):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], MARK]
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


SPANS = "array<struct<start:int,end:int,kind:string>>"


def spans(text: Column) -> Column:
    """All secrets of a text as an array of (start, end, kind)."""
    @F.pandas_udf(SPANS)
    def secret_spans(s: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "kind": k} for a, b, k in find_secrets(t)] for t in s])
    return secret_spans(text)


def scan(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row: key and ``found``, the array of spans."""
    return small_batches(df).select(F.col(key), spans(F.col(text)).alias("found"))


def digest(found: Column, kinds=None) -> Column:
    """kind:start:end of the spans in order, comma-joined."""
    chosen = found if kinds is None else F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows with secrets replaced in ``text`` (and ``n_chars``, if there, recounted)."""
    @F.pandas_udf("string")
    def redacted(s: pd.Series) -> pd.Series:
        return pd.Series([redact_text(t) for t in s], dtype=object)

    out = small_batches(docs).withColumn(text, redacted(F.col(text)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.contains(F.col(text), F.lit(MARK)), F.length(text)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(kind))
    return out
