"""Readers for the line formats.

Blank lines are skipped.  A field that does not parse fails the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.functions.basket import parse_items
from ratingloom.operators.cells import transpose
from ratingloom.operators.index import number_lines, scan_order


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All non-blank lines: ``value``."""
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0)


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The non-blank lines with their position in the files: ``value, pos``."""
    return number_lines(read_lines(spark, path))


def _field(n: int) -> Column:
    return F.trim(F.split("value", ",", -1)[n])


def read_ratings(
    spark: SparkSession, path: str, transposed: bool = False, partitions: int | None = None
) -> DataFrame:
    """``user,item,rating`` lines; further fields are ignored.

    Ids may be written as decimals and are truncated.
    """
    ratings = read_lines(spark, path).select(
        _field(0).cast("double").cast("long").alias("user"),
        _field(1).cast("double").cast("long").alias("item"),
        _field(2).cast("double").alias("rating"),
    )
    ratings = transpose(ratings) if transposed else ratings
    return ratings.repartition(partitions) if partitions else ratings


def read_raw_ratings(spark: SparkSession, path: str) -> DataFrame:
    """``raw user,raw item,rating`` lines with where they stand in the files."""
    return scan_order(spark.read.text(path)).filter(F.length(F.trim("value")) > 0).select(
        _field(0).alias("raw_user"), _field(1).alias("raw_item"),
        _field(2).cast("double").alias("rating"), "_file", "_block", "_line",
    )


RAW_POSITION = ["_file", "_block", "_line"]


def read_baskets(
    spark: SparkSession, path: str, item_type: str = "int", leading_id: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """One basket per line: ``basket, items``.

    With ``leading_id`` the first field is the transaction id and is dropped.
    """
    lines = spark.read.text(path).withColumn("basket", F.monotonically_increasing_id())
    lines = lines.filter(F.length(F.trim("value")) > 0)
    items = parse_items(F.col("value"), "string")
    if leading_id:
        items = F.slice(items, 2, F.size(items))
    if item_type != "string":
        items = F.transform(items, lambda x: F.trim(x).cast(item_type))
    baskets = lines.select("basket", items.alias("items"))
    return baskets.repartition(partitions) if partitions else baskets


def read_dense_rows(spark: SparkSession, path: str) -> DataFrame:
    """``5,5,0,5`` lines: ``row, values``."""
    return read_numbered_lines(spark, path).select(
        F.col("pos").alias("row"), parse_items(F.col("value"), "double").alias("values")
    )


def dense_cells(rows: DataFrame) -> DataFrame:
    """The non-zero cells of dense rows: ``row, col, value``."""
    return rows.select("row", F.posexplode("values").alias("col", "value")).filter("value <> 0")


def read_sparse_rows(spark: SparkSession, path: str) -> DataFrame:
    """``index:value,index:value`` lines: ``row, col, value``."""
    cells = read_numbered_lines(spark, path).select(
        F.col("pos").alias("row"), F.explode(F.split("value", ",", -1)).alias("cell")
    )
    parts = F.split("cell", ":", -1)
    return cells.filter(F.length(F.trim("cell")) > 0).select(
        "row", F.trim(parts[0]).cast("int").alias("col"), F.trim(parts[1]).cast("double").alias("value")
    )


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """``raw,idx`` lines."""
    return read_lines(spark, path).select(_field(0).alias("raw"), _field(1).cast("long").alias("idx"))
