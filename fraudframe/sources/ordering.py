"""File order: the place of a row in the files it was scanned from.

A scan reads blocks of files in any order and on any executor.  Within a block the rows keep the order of
the file, so (file, first byte of the block, running number inside the scan) orders all rows as one reader
going through the files by name would meet them.  "First rows" and "first appearance" are then an
ordinary top-k or minimum over that place: nothing is shuffled to find the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The place of a row: a struct that sorts in file order.
POSITION = "_position"


def with_position(scan: DataFrame) -> DataFrame:
    """``scan`` (a file scan itself, before any other step) and the place of each row in ``_position``.

    The running number is only compared within one file block of one query, where it ascends with
    the file whatever tasks the blocks were dealt to.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("at"))
    return scan.select("*", place.alias(POSITION))


def with_row_number(df: DataFrame, name: str = "row_number", position: str = POSITION) -> DataFrame:
    """Replaces ``_position`` by 0, 1, 2, ... in file order over all files.

    Rows are counted per block; the counts of the blocks before (one row per block) are summed ahead,
    and inside its block a row is numbered by one sort of that block, so no task sees more than a block.
    """
    block = [F.col(f"{position}.file").alias("_file"), F.col(f"{position}.block").alias("_block")]
    counts = df.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_file", "_block").orderBy(f"{position}.at")
    placed = df.select("*", *block).withColumn("_inside", F.row_number().over(inside) - 1)
    met = placed.join(offsets, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return met.withColumn(name, F.col("_before") + F.col("_inside")).drop(
        position, "_file", "_block", "_f", "_b", "_before", "_inside")


def preview(scan: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows of the files, in file order."""
    return with_position(scan).orderBy(POSITION).limit(n).drop(POSITION)
