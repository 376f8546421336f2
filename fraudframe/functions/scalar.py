"""Column expressions: the per-row rules of the pipeline, all JVM-side.

Every function here returns a ``Column``; nothing runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from . import timeformat

# A decimal or scientific number with optional sign and surrounding blanks;
# anything else (currency signs, thousands separators, hex, Java suffixes such
# as "1.5d") is not a number for the pipeline.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_TEXT = ["inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]


WHITESPACE = " \t\n\r\x0b\x0c"


def strip_text(c: Column) -> Column:
    """Strip leading/trailing whitespace including tabs and newlines (no regex)."""
    return F.trim(c, F.lit(WHITESPACE))


def to_number(c: Column, dtype: T.DataType) -> Column:
    """Numeric coercion, bad values -> null (pandas ``to_numeric(errors='coerce')``)."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        return F.when(~F.isnan(d), d)
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    txt = c.cast("string")
    ok = txt.rlike(NUMERIC_TEXT) | F.lower(strip_text(txt)).isin(INFINITY_TEXT)
    return F.when(ok, strip_text(txt).try_cast("double"))


def label_text(c: Column) -> Column:
    """Label as lower-cased, stripped text (null stays null)."""
    return F.lower(strip_text(c.cast("string")))


def mapped_label(c: Column) -> Column:
    """Known label spelling -> 0/1, otherwise null."""
    m = F.create_map(*[x for k, v in S.LABEL_VALUES.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, label_text(c)).cast("int")


def numeric_label(c: Column, dtype: T.DataType) -> Column:
    """Fallback label: numeric value > 0 -> 1, anything else (incl. missing) -> 0."""
    return F.coalesce(to_number(c, dtype) > 0, F.lit(False)).cast("int")


def parse_timestamp(c: Column, dtype: T.DataType, fmt: str | None = None) -> Column:
    """Timestamp parse; bad text -> null.  Numbers are epoch nanoseconds.

    ``fmt`` is the one form of a text column (None: ISO), see :mod:`fraudframe.functions.timeformat`.
    """
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.IntegralType):
        # Integer division, rounding down: a double cannot hold nanoseconds since 1970.
        n = c.cast("long")
        micros = F.call_function("div", n - F.pmod(n, F.lit(1000)), F.lit(1000))
        return F.timestamp_micros(micros).cast("timestamp_ntz")
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.timestamp_micros(F.floor(c.cast("double") / 1000).cast("long")).cast("timestamp_ntz")
    text = strip_text(c.cast("string"))
    if fmt is None:
        return text.try_cast("timestamp_ntz")
    return timeformat.parse(text, fmt)


def weekday_monday0(ts: Column) -> Column:
    return F.weekday(ts)


def hour_flag(cond: Column) -> Column:
    """0/1 flag where a missing hour counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def is_night(hour: Column) -> Column:
    return hour_flag((hour < S.NIGHT_BEFORE_HOUR) | (hour > S.NIGHT_AFTER_HOUR))


def is_business_hours(hour: Column) -> Column:
    return hour_flag((hour >= S.BUSINESS_FIRST_HOUR) & (hour <= S.BUSINESS_LAST_HOUR))


def is_weekend(day_of_week: Column) -> Column:
    return F.coalesce(day_of_week.isin(*S.WEEKEND_DAYS), F.lit(False))


def is_rare(freq: Column) -> Column:
    return F.coalesce(freq <= S.RARE_FREQUENCY_MAX, F.lit(False)).cast("int")


def is_whole(amount: Column) -> Column:
    return F.coalesce((amount % 1) == 0, F.lit(False)).cast("int")


def format_currency(x: Column) -> Column:
    """``$1,234.50``."""
    return F.concat(F.lit("$"), F.format_number(x, 2))


def format_percentage(x: Column) -> Column:
    """Fraction as ``12.34%``."""
    return F.format_string("%.2f%%", x * 100)


def safe_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den, ``default`` when den is 0 or missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(default))
