"""Column detection over many files from stored facts per file.

What detection asks of a column can be merged: counts add up, lowest and highest values and label members
combine, distinct ids are sketches that unite.  So the facts of every file are kept in a small table, one row a
file, and a further upload costs a scan of the new (or changed) files only; detection itself reads the
facts.  Rules and results are those of :func:`fraudframe.operators.detect.detect_columns` over all files at once; only a
user id whose estimated share lies within the sketch's error of the bound is counted over the files again.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import scalar as X
from ..functions import timeformat
from ..session import materialize, release
from .detect import name_candidates

#: Size of the id sketch (2^16 registers, a standard error of 0.4 %), and the relative error it is not trusted within.
SKETCH, ID_ERROR = 16, 0.02
ISO = "iso"
LABELS = sorted({v for values in S.BINARY_LABEL_SETS for v in values})


def _changed(spark: SparkSession, path: str) -> int:
    """Time of the last change, by Spark's own file system layer."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()


def file_facts(scan: DataFrame) -> DataFrame:
    """One row per file of a file scan: what detection needs of the columns whose names it would take."""
    found = name_candidates(scan.columns)
    columns = [c for c in dict.fromkeys(found.values())]
    rows = scan.select(F.col("_metadata.file_path").alias("_file"), *[F.col(f"`{c}`") for c in columns])
    aggs = [F.count(F.lit(1)).alias("rows")]
    for field, column in found.items():
        c, kind = F.col(f"`{column}`"), scan.schema[column].dataType
        aggs.append(F.count(c).alias(f"{field}_present"))
        if field == "amount":
            num = X.to_number(c, kind)
            aggs += [F.count(num).alias("amount_numbers"), F.count_if(num >= 0).alias("amount_valid")]
        elif field == "fraud_label":
            text = F.lower(c.cast("string"))
            aggs += [F.array(*[F.count_if(text == v) for v in LABELS]).alias("fraud_label_counts")]
        elif field == "timestamp":
            forms = timeformat.candidates(rows, column, group="_file") if isinstance(kind, T.StringType) else []
            bad = [x for f in forms for x in (F.lit(f or ISO), F.count_if(c.isNotNull() & X.parse_timestamp(c, kind, f).isNull()))]
            none = F.lit(None).cast("map<string,bigint>")
            aggs.append((F.create_map(*bad) if bad else none).alias("timestamp_bad"))
        elif field in S.CATEGORICAL_FIELDS:
            text = c if isinstance(kind, T.StringType) else F.lit(None).cast("string")
            aggs += [F.min(text).alias(f"{field}_low"), F.max(text).alias(f"{field}_high")]
        elif field == "user_id":
            aggs.append(F.hll_sketch_agg(c.cast("string"), SKETCH).alias("user_id_sketch"))
    return rows.groupBy("_file").agg(*aggs).withColumnRenamed("_file", "file")


def update_facts(spark: SparkSession, paths: list[str], read: Callable[[list[str]], DataFrame], store: str) -> list[str]:
    """Bring the facts under ``store`` up to the files ``paths``; returns the files that had to be scanned.

    ``read`` scans a list of files.  Every update writes the whole (small) table as a new version and names it last.
    """
    known = _stored(spark, store)
    times = {p: _changed(spark, p) for p in paths}
    have = {r["path"]: r["changed"] for r in known.select("path", "changed").collect()} if known is not None else {}
    fresh = [p for p in paths if have.get(p) != times[p]]
    if fresh:
        facts = materialize(file_facts(read(fresh)), "facts")  # all new files in one scan
        names = {_plain(p): p for p in fresh}
        stamp = [(r["file"], names[_plain(r["file"])], times[names[_plain(r["file"])]]) for r in facts.select("file").collect()]
        # A file without rows has no row of facts; it is remembered all the same.
        stamp += [(p, p, times[p]) for p in fresh if p not in {s[1] for s in stamp}]
        new = spark.createDataFrame(stamp, "file string, path string, changed long").join(facts, "file", "left")
        if known is not None:
            new = known.where(~F.col("path").isin(fresh)).unionByName(new, allowMissingColumns=True)
        number = max(_versions(spark, store), default=0) + 1
        new.coalesce(1).write.parquet(f"{store}/{number:08d}")
        release(facts)
    return fresh


def _plain(path: str) -> str:
    """A path as it is compared: scheme and folders, whatever slashes and escapes it is written with."""
    return re.sub(r"^(?:file:)?/+", "file:/", unquote(path))


def _versions(spark: SparkSession, store: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(s.getPath().getName()) for s in system.listStatus(folder) if system.exists(done(s.getPath(), "_SUCCESS")))


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    versions = _versions(spark, store)
    return spark.read.parquet(f"{store}/{versions[-1]:08d}") if versions else None


def detect_from_facts(spark: SparkSession, store: str, paths: list[str], read: Callable[[list[str]], DataFrame]) -> dict[str, str]:
    """canonical field -> source column over the files ``paths``, from their stored facts alone.

    ``read`` gives the columns and their types, and the ids if their share is too near its bound for a sketch.
    """
    scan = read(paths)
    found = name_candidates(scan.columns)
    rows = _stored(spark, store).where(F.col("path").isin(paths))
    have = set(rows.columns)
    sums = [F.sum("rows").alias("rows")]
    sums += [F.sum(c).alias(c) for c in sorted(have) if c.endswith(("_present", "_numbers", "_valid"))]
    sums += [f(c).alias(c) for end, f in (("_low", F.min), ("_high", F.max)) for c in sorted(have) if c.endswith(end)]
    if "fraud_label_counts" in have:
        sums += [F.sum(F.col("fraud_label_counts")[i]).alias(f"label_{v}") for i, v in enumerate(LABELS)]
    if "user_id_sketch" in have:
        sums.append(F.hll_sketch_estimate(F.hll_union_agg("user_id_sketch")).alias("ids"))
    r = {k: 0 if v is None and not k.endswith(("_low", "_high")) else v for k, v in rows.agg(*sums).first().asDict().items()}
    passed = {}
    for field, column in found.items():
        kind = scan.schema[column].dataType
        if field == "amount":
            passed[field] = r["amount_numbers"] > 0 and r["amount_valid"] > 0
        elif field == "fraud_label":
            passed[field] = any(sum(r[f"label_{v}"] for v in values) == r["fraud_label_present"] or all(r[f"label_{v}"] for v in values)
                                for values in S.BINARY_LABEL_SETS)
        elif field == "timestamp":
            passed[field] = not isinstance(kind, T.StringType) or _one_form(rows)
        elif field in S.CATEGORICAL_FIELDS:
            low, high, present = r[f"{field}_low"], r[f"{field}_high"], r[f"{field}_present"]
            passed[field] = isinstance(kind, T.StringType) and present > 0 and (low < high or present < r["rows"])
        elif field == "user_id":
            missing = int(r["user_id_present"] < r["rows"])
            share = (r["ids"] + missing) / r["rows"] if r["rows"] else 0.0
            if abs(share - S.USER_ID_MIN_UNIQUE_RATIO) <= ID_ERROR * S.USER_ID_MIN_UNIQUE_RATIO:
                share = (scan.agg(F.count_distinct(F.col(f"`{column}`"))).first()[0] + missing) / r["rows"]
            passed[field] = share > S.USER_ID_MIN_UNIQUE_RATIO
    return {f: c for f, c in found.items() if passed.get(f, False)}


def _one_form(rows: DataFrame) -> bool:
    """Whether one form reads every present value of every file that has values."""
    files = rows.where("timestamp_present > 0")
    each = files.select("path", F.explode("timestamp_bad").alias("form", "bad")).where("bad = 0")
    full = each.groupBy("form").agg(F.count_distinct("path").alias("n")).agg(F.max("n")).first()[0]
    return (full or 0) == files.count()
