"""CSV as other programs write and read it, rejects, type joins over sources, file order, duplicates by digest."""

import glob
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudframe.operators import profile, quality
from fraudframe.session import scratch_path
from fraudframe.sources import ingest, ordering

VALUES = ["plain", 'say "hi"', "a,b", "line\nend", "cr\rend", "crlf\r\nend", "back\\slash", "tail\\", '"', '""', " lead", "tail ",
          "tab\t", 'x"y,z\n"q"', "#", "é日", "'single'", '\\"', "a\\,b", "\n", '",\n"']


def one_csv(folder):
    return glob.glob(folder.removeprefix("file:") + "/*.csv")


def test_csv_round_trip_and_pandas_reads_it(spark):
    rows = [(1234567890123456700 + i, v, i * 0.5) for i, v in enumerate(VALUES)]
    df = spark.createDataFrame(rows, "id long, v string, x double").coalesce(1)
    path = ingest.export_csv(df, scratch_path(spark, "csv"))
    assert sorted(map(tuple, ingest.scan_csv(spark, path).collect())) == rows
    back = pd.read_csv(one_csv(path)[0], keep_default_na=False)
    assert list(back.itertuples(index=False, name=None)) == rows


def test_what_pandas_writes_is_read(spark, tmp_path):
    frame = pd.DataFrame({"id": range(len(VALUES)), "merchant": VALUES})
    frame.to_csv(tmp_path / "a.csv", index=False)
    got = ingest.scan_csv(spark, str(tmp_path / "a.csv")).orderBy("id").collect()
    assert [r["merchant"] for r in got] == VALUES
    (tmp_path / "b.csv").write_text('id,amount,merchant,n\n1,"1,200.5","Joe ""Big"" Bar",0\n2,7,"Two\nLines",1\n')
    df = ingest.scan_csv(spark, str(tmp_path / "b.csv"))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "1,200.5", 'Joe "Big" Bar', 0), (2, "7", "Two\nLines", 1)]
    assert dict(df.dtypes)["id"] == "bigint"


def test_plain_files_stay_splittable(spark, tmp_path):
    (tmp_path / "p.csv").write_text('a,b\n1,"x ""y"" z"\n2,"u,v"\n')
    assert not ingest.has_line_ends_in_quotes(spark, str(tmp_path / "p.csv"))
    assert ingest.scan_csv(spark, str(tmp_path / "p.csv")).count() == 2
    (tmp_path / "q.csv").write_text('a,b\n1,"x\ny"\n')
    assert ingest.has_line_ends_in_quotes(spark, str(tmp_path / "q.csv"))


def test_long_ids_stay_apart(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("id,wide,wider,mixed,plus\n1234567890123456789,99999999999999999999,{0}1,1.5,+7\n"
                                      "1234567890123456788,99999999999999999998,{0}2,12345678901234567890,NA\n".format("9" * 38))
    df = ingest.scan_csv(spark, str(tmp_path / "ids.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "wide": "decimal(38,0)", "wider": "string", "mixed": "double", "plus": "bigint"}
    assert all(df.select(c).distinct().count() == 2 for c in ("id", "wide", "wider"))


def test_every_record_is_good_or_rejected(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,amount,note\n1,2.5,x\n2,abc,y\n3,4,"q ""z"", r"\n4,5\n5,6,u,v\n6,NA,\n')
    (tmp_path / "b.csv").write_text("id,amount,note\nx,1,bad id\n8, 9 ,ok\n")
    good, rejects = ingest.scan_csv_rejects(spark, str(tmp_path), "id int, amount double, note string")
    assert sorted(map(tuple, good.collect())) == [(1, 2.5, "x"), (3, 4.0, 'q "z", r'), (6, None, None), (8, 9.0, "ok")]
    rows = sorted((r["file"].rsplit("/", 1)[1], r["cause"], r["record"]) for r in rejects.collect())
    assert rows == [("a.csv", "amount: not a double", "2,abc,y"), ("a.csv", "wrong number of fields", "4,5"),
                    ("a.csv", "wrong number of fields", "5,6,u,v"), ("b.csv", "id: not a int", "x,1,bad id")]
    assert good.count() + rejects.count() == 8


def test_joined_types():
    j = ingest.joined_type
    assert j(T.IntegerType(), T.LongType()) == T.LongType() and j(T.LongType(), T.DoubleType()) == T.DoubleType()
    assert j(T.StringType(), T.LongType()) == T.StringType() and j(T.BooleanType(), T.LongType()) == T.StringType()
    assert j(T.DateType(), T.TimestampType()) == T.TimestampType() and j(T.DateType(), T.LongType()) == T.StringType()
    assert j(T.DecimalType(10, 2), T.LongType()) == T.DecimalType(21, 2) and j(T.NullType(), T.DateType()) == T.DateType()


def test_union_does_not_depend_on_the_order_of_sources(spark):
    a = spark.sql("select 1 as id, 7 as v, true as b")
    b = spark.sql("select 2 as id, 1.5D as v, 1 as b")
    c = spark.sql("select 3L as id, 'x' as v, null as b, 5 as extra")
    want = {(1, "7", "True", None), (2, "1.5", "1", None), (3, "x", None, 5)}
    for frames in ([a, b, c], [c, b, a], [b, a, c]):
        out = ingest.union_sources(frames)
        assert {(r["id"], r["v"], r["b"], r["extra"]) for r in out.collect()} == want
        assert dict(out.dtypes)["id"] == "bigint"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Five files in which neither ids nor values ascend."""
    folder = tmp_path_factory.mktemp("order")
    rows = []
    for f in range(5):
        part = [(f * 1000 + (i * 7919) % 1000, f"m{(i * i + f) % 11}", (i + f) % 3 == 0) for i in range(200)]
        rows += part
        pd.DataFrame(part, columns=["id", "merchant", "fraud"]).to_csv(folder / f"f{f}.csv", index=False)
        pd.DataFrame(part, columns=["id", "merchant", "fraud"]).to_parquet(folder / f"f{f}.parquet")
    return folder, rows


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_first_rows_and_numbers_in_file_order(spark, files, kind):
    folder, rows = files
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # several blocks a file, dealt by size
    try:
        path = f"{folder}/*.{kind}"
        scan = ingest.scan_csv(spark, path, "id long, merchant string, fraud boolean") if kind == "csv" else spark.read.parquet(path)
        raw = spark.read.schema("id long, merchant string, fraud boolean").option("header", True).csv(path) if kind == "csv" else scan
        assert [tuple(r) for r in ordering.preview(raw, 250).collect()] == rows[:250]
        placed = ordering.with_position(raw)
        numbered = ordering.with_row_number(placed).orderBy("row_number").collect()
        assert [(r["id"], r["merchant"], r["fraud"]) for r in numbered] == rows
        assert [r["row_number"] for r in numbered] == list(range(1000))
        head = profile.fraud_head(placed.withColumn("is_fraud", F.col("fraud").cast("int")), ordering.POSITION).collect()
        assert [r["id"] for r in head] == [r[0] for r in rows if r[2]][:20]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ties_stand_by_first_appearance(spark, files):
    folder, rows = files
    placed = ordering.with_position(spark.read.parquet(f"{folder}/*.parquet")).withColumn("is_fraud", F.col("fraud").cast("int"))
    want = Counter(r[1] for r in rows if r[2]).most_common(10)  # equal counts stay in order of appearance
    got = [(r["merchant"], r["fraud_count"]) for r in profile.top_fraud_category(placed, "merchant").collect()]
    assert got == want and len({n for _, n in want}) < len(want)


def test_duplicates_are_compared_whole(spark, monkeypatch):
    rows = [(1, "a", None, 0.0), (1, "a", None, -0.0), (None, "a", 1, 2.0), (1, "a", None, 0.0), (2, "b", 3, float("nan")),
            (2, "b", 3, float("nan")), (3, None, "a" and 4, 1.0), (4, "c", 5, 6.0)]
    df = spark.createDataFrame(rows, "x int, y string, z int, w double").repartition(3)
    assert quality.duplicate_rows(df).first()[0] == 3
    assert quality.duplicate_rows(df.limit(0)).first()[0] == 0
    # Even if all digests were equal.
    monkeypatch.setattr(quality, "row_digest", lambda d: [F.lit(7).cast("long").alias("_d0"), F.lit(7).cast("long").alias("_d1")])
    assert quality.duplicate_rows(df).first()[0] == 3
