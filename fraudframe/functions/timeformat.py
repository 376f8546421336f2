"""The form of a text column of times, inferred from the whole column.

Every value is reduced to a template: runs of digits become ``n`` (one or two), ``Y`` (four) or ``D`` (eight), names of
months ``b`` or ``B``, a fraction of a second ``F``, a half of the day ``P``; what does not matter for the wall
time (the day of the week, the zone) is taken out.  One aggregate counts the templates with the largest number at each
place, which decides between day and month: a place that ever goes above 12 is no month.  The frequent templates
give the candidate forms, and the form that reads the most values is the column's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_WEEKDAY = r"(?i)^\s*(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?[.,]?\s+"
_ZONE = r"(?i)(:\d\d(?:[.]\d+)?(?:\s*[ap][.]?m\b[.]?)?)\s*(?:z|utc|gmt|[+-]\d\d:?\d\d|[+-]\d\d)\s*$"
_HALF = r"(?i)(\d)\s*([ap])[.]?m\b[.]?"
#: Templates looked at, the most frequent first (a column of one form has a few of them).
TEMPLATES = 16
#: Two-digit years from here on are of the last century (a fixed value of the usual parsers).
PIVOT = 69


def wall_text(text: Column) -> Column:
    """The text without the day of the week and the zone, halves of the day spelled `` AM`` and `` PM``."""
    plain = F.regexp_replace(F.regexp_replace(text, _WEEKDAY, ""), _ZONE, "$1")
    plain = F.regexp_replace(plain, _HALF, "$1 $2M")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def template(text: Column) -> Column:
    """The template of a :func:`wall_text`."""
    t = F.lower(text)
    t = F.regexp_replace(t, r"\b(?:" + "|".join(m for m in MONTHS if len(m) > 3) + r")\b", "B")
    t = F.regexp_replace(t, r"\b(?:" + "|".join(m[:3] for m in MONTHS) + r")\b", "b")
    t = F.regexp_replace(t, r"(:\d\d)[.]\d{1,9}", "$1.F")
    t = F.regexp_replace(t, r"\b[ap]m\b", "P")
    t = F.regexp_replace(t, r"(?<!\d)\d{8}(?!\d)", "D")
    t = F.regexp_replace(t, r"(?<!\d)\d{4}(?!\d)", "Y")
    return F.regexp_replace(t, r"(?<!\d)\d{1,2}(?!\d)", "n")


_DATES = [  # template, its forms (s: the separator; month first where both are possible)
    (r"Y([-/. ])n\1n", ["yyyy{s}M{s}d"]), (r"n([-/. ])n\1Y", ["M{s}d{s}yyyy", "d{s}M{s}yyyy"]),
    (r"n([-/. ])n\1n", ["M{s}d{s}yy", "d{s}M{s}yy", "yy{s}M{s}d"]),
    (r"n([-/. ])b\1Y", ["d{s}MMM{s}yyyy"]), (r"n([-/. ])b\1n", ["d{s}MMM{s}yy"]), (r"n([-/. ])B\1Y", ["d{s}MMMM{s}yyyy"]),
    (r"Y([-/. ])b\1n", ["yyyy{s}MMM{s}d"]), (r"b( )n, Y", ["MMM d, yyyy"]), (r"B( )n, Y", ["MMMM d, yyyy"]),
    (r"b( )n Y", ["MMM d yyyy"]), (r"B( )n Y", ["MMMM d yyyy"]), (r"(D)", ["yyyyMMdd"]),
]
_TIME = re.compile(r"(,? |t)?n:n(:n)?([.]F)?( P)?")


def _time_form(t: str) -> str | None:
    if not t:
        return ""
    m = _TIME.fullmatch(t)
    if not m or not m[1] or (m[3] and not m[2]):
        return None
    lead = "'T'" if m[1] == "t" else m[1]
    return lead + ("h" if m[4] else "H") + ":m" + (":s" if m[2] else "") + (".SSSSSSSSS" if m[3] else "") + (" a" if m[4] else "")


def forms_of(found: str, largest: list[int | None]) -> list[str]:
    """Forms that can read a template whose first three numbers go up to ``largest``."""
    for pattern, forms in _DATES:
        m = re.match(pattern, found)
        if not m:
            continue
        time = _time_form(found[m.end():])
        if time is None:
            continue
        out = []
        for form in forms:
            places = re.findall(r"y+|M+|d+", form)
            month = places.index("M") if "M" in places else None
            if month is not None and largest[month] is not None and largest[month] > 12:
                continue
            day = places.index("d") if "d" in places else None
            if form != "yyyyMMdd" and day is not None and "MMM" not in form and largest[day] is not None and largest[day] > 31:
                continue
            out.append(form.format(s=m[1]) + time)
        return out
    return []


def candidates(df: DataFrame, column: str, kept: Column | None = None, group: str | None = None) -> list[str | None]:
    """Forms worth trying for a text column, from one aggregate over it; None (ISO) is always the first.

    With ``group`` the values of every group (a file, say) suggest forms of their own.
    """
    text = wall_text(F.col(f"`{column}`"))
    rows = df.where(F.col(f"`{column}`").isNotNull()) if kept is None else df.where(F.col(f"`{column}`").isNotNull() & kept)
    numbers = F.regexp_extract_all("_t", F.lit(r"(\d+)"))
    tops = [F.max(F.try_element_at(numbers, F.lit(i + 1)).try_cast("int")).alias(f"n{i}") for i in range(3)]
    part = F.col(group) if group else F.lit(0)
    counts = (rows.select(part.alias("_g"), text.alias("_t")).groupBy("_g", template(F.col("_t")).alias("template"))
              .agg(F.count(F.lit(1)).alias("n"), *tops))
    order = [F.col("n").desc(), F.col("template").asc()]
    if group:
        place = F.row_number().over(Window.partitionBy("_g").orderBy(*order))
        found = counts.withColumn("_place", place).where(F.col("_place") <= TEMPLATES).collect()
    else:
        found = counts.orderBy(*order).limit(TEMPLATES).collect()
    out: list[str | None] = [None]
    for r in found:
        out += [f for f in forms_of(r["template"], [r["n0"], r["n1"], r["n2"]]) if f not in out]
    return out


def parse(text: Column, form: str) -> Column:
    """``text`` read by ``form`` as wall time; null where it does not fit."""
    ts = F.try_to_timestamp(wall_text(text), F.lit(form)).cast("timestamp_ntz")
    if re.search(r"(?<!y)yy(?!y)", form):
        century = F.make_ym_interval(F.lit(-100), F.lit(0))
        return F.when(F.year(ts) >= 2000 + PIVOT, ts + century).otherwise(ts)
    return ts
