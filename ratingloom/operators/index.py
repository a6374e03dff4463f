"""Dense numbering of rows and ids without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.session import stage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low bits


def dense_index(df: DataFrame, order: list[Column | str], name: str = "idx", start: int = 0) -> DataFrame:
    """Number the rows ``start, start+1, ...`` in the given order.

    The rows are range-partitioned and sorted within partitions; each partition
    then only needs the number of rows before it.  The sorted rows are staged
    once, so that the counting pass and the numbering pass see the same
    partitions.  The order must be total for the numbers to be reproducible.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = stage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))),
        "ranged",
    )
    # One row per range partition: bounded by the number of shuffle partitions,
    # whatever the data, so one task and a broadcast are safe here.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    return ranged.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + F.col("_row") + F.lit(start)).cast("long").alias(name)
    )


def ids_by_value(df: DataFrame, column: str) -> DataFrame:
    """Dense ids for the distinct values of ``column`` in sorted order: ``raw, idx``."""
    raw = df.select(F.col(column).alias("raw")).filter(F.col("raw").isNotNull()).distinct()
    return dense_index(raw, ["raw"])


def ids_by_first_seen(df: DataFrame, column: str, position: list[str]) -> DataFrame:
    """Dense ids for the distinct values of ``column`` by first appearance: ``raw, idx``.

    ``position`` names the columns that order the rows.  Only the first position
    of every value is sorted, never the rows themselves.
    """
    first = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("raw"))
        .agg(F.min(F.struct(*position)).alias("_first"))
    )
    return dense_index(first, ["_first", "raw"]).select("raw", "idx")


def encode(df: DataFrame, column: str, ids: DataFrame, name: str) -> DataFrame:
    """Replace a raw column by its dense id."""
    lookup = ids.select(F.col("raw").alias(column), F.col("idx").alias(name))
    return df.join(lookup, column).drop(column)


def scan_order(lines: DataFrame) -> DataFrame:
    """Add where each line of a text source stands: ``_file, _block, _line``.

    Must be called on the untouched reader output.  Rows of one file split are
    read in order within one task, so file, split start and the row counter of
    the task together give the order of the lines.
    """
    return lines.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def number_lines(lines: DataFrame, name: str = "pos") -> DataFrame:
    """Number the lines of a text source from 0 in file order, without a sort.

    Every split numbers its own lines; the splits' line counts give the offsets.
    """
    placed = stage(scan_order(lines), "lines")
    splits = placed.groupBy("_file", "_block").agg(
        F.min("_line").alias("_start"), F.count(F.lit(1)).alias("_rows")
    )
    # One row per file split, not per line.
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    return placed.join(offsets, ["_file", "_block"]).select(
        *lines.columns, (F.col("_offset") + F.col("_line") - F.col("_start")).cast("long").alias(name)
    )
