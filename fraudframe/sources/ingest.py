"""Sources and sinks: CSV / JSON / parquet scans, records in and out, previews.

CSV is the reference's only file format.  The scan splits files across
tasks (no chunk loop); pandas' missing-value spellings are mapped to null
after the scan and NaN doubles to null, so later null semantics match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import scalar as X
from ..session import materialize

QUOTE = '"'
CORRUPT = "_corrupt"
WIDE = "decimal(38,0)"
#: Types a text column is tried for, in this order; whole numbers too wide for the first two stay text.
KINDS = ["bigint", WIDE, "string", "double", "boolean"]


def normalize_missing(df: DataFrame, tokens: bool = False) -> DataFrame:
    """NaN doubles -> null; with ``tokens``, pandas' NA spellings in text -> null."""
    cols = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols[f.name] = F.when(~F.isnan(c), c)
        elif tokens and isinstance(f.dataType, T.StringType):
            cols[f.name] = F.when(~c.isin(*S.CSV_MISSING_TOKENS), c)
    return df.withColumns(cols) if cols else df


def _csv_text(spark: SparkSession, path, multi_line: bool | None, mode: str = "PERMISSIVE"):
    """A reader for header CSV in which a quote inside quotes is written twice and a backslash is itself."""
    if multi_line is None:
        multi_line = has_line_ends_in_quotes(spark, path)
    return (spark.read.option("header", True).option("mode", mode).option("quote", QUOTE).option("escape", QUOTE)
            .option("multiLine", multi_line).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def has_line_ends_in_quotes(spark: SparkSession, path) -> bool:
    """Whether some value holds a line end, from one distributed pass over the plain lines.

    A line that ends inside quotes is the first one of its record to do so or follows one; the first
    has an odd number of quotes.  Without such a line the files can be split at any line end.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    return bool(spark.read.text(path).where(quotes % 2 == 1).limit(1).count())


def scan_csv(spark: SparkSession, path, schema: T.StructType | str | None = None, infer_schema: bool = True,
             mode: str = "PERMISSIVE", multi_line: bool | None = None) -> DataFrame:
    """Header CSV scan (one or many files) with pandas' quoting and missing-value rules.

    Give ``schema`` in production; inference costs an extra pass over the data.
    ``mode="FAILFAST"`` turns a malformed row into an error (the input gate).
    ``multi_line``: values may hold line ends, which makes every file one task; False promises that none
    does; left open, one pass over the lines decides, so plain files stay splittable.
    """
    reader = _csv_text(spark, path, multi_line, mode)
    if schema is not None:
        reader = reader.schema(schema)
    df = check_column_names(normalize_missing(reader.csv(path), tokens=True))
    return infer_types(df) if schema is None and infer_schema else df


def scan_csv_rejects(spark: SparkSession, path, schema: T.StructType | str, multi_line: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects): every record of the files is in exactly one of the two.

    A record is rejected if it has more or fewer fields than the header, or a value that is not of its column's type.
    Rejects are (file, cause, record): the cause names the first bad column, the record is its text (for a wrong
    number of fields as it stands in the file, else written anew).  The files are parsed once, into a
    written table that both results are read from.
    """
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField(CORRUPT, T.StringType())])
    reader = _csv_text(spark, path, multi_line).schema(texts).option("columnNameOfCorruptRecord", CORRUPT)
    parsed = reader.csv(path).select("*", F.col("_metadata.file_path").alias("_file"))
    values = normalize_missing(parsed, tokens=True)
    typed, bad = [], F.when(F.col(CORRUPT).isNotNull(), F.lit("wrong number of fields"))
    for f in schema:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        value = c if isinstance(f.dataType, T.StringType) else X.strip_text(c).try_cast(f.dataType)
        typed.append(value.alias(f.name))
        bad = bad.when(c.isNotNull() & value.isNull(), F.lit(f"{f.name}: not a {kind}"))
    record = F.to_csv(F.struct(*[F.col(f"`{f.name}`") for f in schema]), {"quote": QUOTE, "escape": QUOTE})
    split = materialize(values.select(*typed, "_file", bad.alias("_cause"), F.coalesce(F.col(CORRUPT), record).alias("_record")), "csv-rejects")
    good = split.where(F.col("_cause").isNull()).select(*[F.col(f"`{f.name}`") for f in schema])
    rejects = split.where(F.col("_cause").isNotNull()).select(
        F.col("_file").alias("file"), F.col("_cause").alias("cause"), F.col("_record").alias("record"))
    return good, rejects


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns whose present values are all whole numbers, numbers or truth values, retyped.

    Missing-value spellings are null by now, so they do not keep a column text (one aggregate over all columns);
    a column without values stays text.  Whole numbers beyond 64 bits become a wide decimal, beyond its 38 digits
    they stay text: never a double, in which two ids could become one.  A whole-number column with nulls stays integral: the label
    rule reads "was numeric, with missing values" off that.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    whole, boolean = r"^\s*[+-]?\d+\s*$", r"^\s*(?i:true|false)\s*$"
    aggs = []
    for i, c in enumerate(text):
        col = F.col(f"`{c}`")
        is_whole = col.rlike(whole)
        tests = {"bigint": X.strip_text(col).try_cast("bigint").isNotNull() & is_whole,
                 WIDE: X.strip_text(col).try_cast(WIDE).isNotNull() & is_whole, "string": is_whole,
                 "double": col.rlike(X.NUMERIC_TEXT), "boolean": col.rlike(boolean)}
        aggs.append(F.count(col).alias(f"n{i}"))
        aggs += [F.count_if(t).alias(f"{KINDS.index(k)}_{i}") for k, t in tests.items()]
    if not aggs:
        return df
    r = df.agg(*aggs).first()
    casts = {}
    for i, c in enumerate(text):
        kind = next((k for j, k in enumerate(KINDS) if r[f"n{i}"] and r[f"{j}_{i}"] == r[f"n{i}"]), None)
        if kind and kind != "string":
            casts[c] = X.strip_text(F.col(f"`{c}`")).cast(kind)
    return df.withColumns(casts) if casts else df


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalize_missing(spark.read.parquet(path))


#: Numbers by width: a column takes the widest of its sources.
NUMBERS = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType]


def joined_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds a column of both types, as a data frame library joins them.

    Whole numbers widen to the wider one, with a fraction anywhere to double; days and moments to moments;
    truth values and text, like any other pair, meet only as text.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    ranks = [next((i for i, k in enumerate(NUMBERS) if isinstance(t, k)), None) for t in (a, b)]
    if None not in ranks:
        wide = max(ranks)
        if wide <= 3:
            return (a, b)[ranks.index(wide)]
        if wide == 4:
            scale = max(getattr(t, "scale", 0) for t in (a, b))
            whole = max(t.precision - t.scale if isinstance(t, T.DecimalType) else 19 for t in (a, b))
            return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()
        return T.DoubleType()
    moments = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, moments) and isinstance(b, moments):
        return a if isinstance(b, T.DateType) else b
    return T.StringType()


def as_type(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """``c`` as the joined type; truth values are spelled True and False as text."""
    if have == want:
        return c
    if isinstance(have, T.BooleanType) and isinstance(want, T.StringType):
        return F.when(c, "True").when(~c, "False")
    return c.cast(want)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Union-all by column name (missing columns become null).

    The type of a column is joined over all sources before the union, so neither their order nor the
    engine's own casts (which fail on text that is no number) decide it.
    """
    kinds: dict[str, T.DataType] = {}
    for f in frames:
        for x in f.schema.fields:
            kinds[x.name] = joined_type(kinds[x.name], x.dataType) if x.name in kinds else x.dataType
    # A joined type may join further with the next source: one more round settles it.
    for f in frames:
        for x in f.schema.fields:
            kinds[x.name] = joined_type(kinds[x.name], x.dataType)
    out = None
    for f in frames:
        own = f.select(*[as_type(F.col(f"`{x.name}`"), x.dataType, kinds[x.name]).alias(x.name) for x in f.schema.fields])
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """First n rows by ``key`` (a table has no order of its own)."""
    return df.orderBy(F.col(key).asc()).limit(n)


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def export_csv(df: DataFrame, path: str) -> str:
    """Header CSV; values with separators, quotes or line ends are quoted, a quote inside is written twice."""
    (df.write.mode("overwrite").option("header", True).option("quote", QUOTE).option("escape", QUOTE)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
    return path


def export_json(df: DataFrame, path: str) -> str:
    """JSON lines, one record per row (the reference's ``to_dict('records')``)."""
    df.write.mode("overwrite").json(path)
    return path


def records_in(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Records written as JSON lines back into a table."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return normalize_missing(reader.json(path))


def readable_sample(spark: SparkSession, path: str, rows: int = 10, multi_line: bool | None = None) -> tuple[bool, str]:
    """The readability gate: the first ``rows`` rows parse (FAILFAST), at least 2 columns.

    Parses only the leading split(s) of the input; with ``multi_line`` left open, one pass over its lines looks for
    line ends in quotes first.
    """
    try:
        df = _csv_text(spark, path, multi_line, "FAILFAST").csv(path)
        sample = df.limit(rows).collect()
    except Exception as e:  # malformed input is the answer, not a crash
        return False, f"Failed to read CSV file: {str(e).splitlines()[0]}"
    if not sample:
        return False, "Uploaded file is empty"
    if len(df.columns) < 2:
        return False, "File must have at least 2 columns"
    return True, "File validation successful"


def check_column_names(df: DataFrame) -> DataFrame:
    """Reject names that differ only by case (Spark resolves names case-insensitively)."""
    seen: dict[str, str] = {}
    for c in df.columns:
        low = c.lower()
        if low in seen and seen[low] != c:
            raise ValueError(f"Columns {seen[low]!r} and {c!r} differ only by case")
        seen[low] = c
    return df
