"""Rating and basket tables derived from an order database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the stored tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _lines_with_customer(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.join(orders, "l_orderkey")


def _brands(spark: SparkSession, folder: str) -> DataFrame:
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long")
    return table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), number.alias("brand"))


def _rating() -> F.Column:
    return (F.avg("l_quantity") / 10).alias("rating")


def ratings_brand(spark: SparkSession, folder: str) -> DataFrame:
    """How much customers buy of each brand: few items, dense rows."""
    return (
        _lines_with_customer(spark, folder)
        .join(_brands(spark, folder), "l_partkey")
        .groupBy(F.col("o_custkey").alias("user"), F.col("brand").alias("item"))
        .agg(_rating())
    )


def ratings_part(spark: SparkSession, folder: str) -> DataFrame:
    """How much customers buy of each part: many items, sparse rows."""
    return (
        _lines_with_customer(spark, folder)
        .groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"))
        .agg(_rating())
    )


def ratings_supplier(spark: SparkSession, folder: str) -> DataFrame:
    """How much suppliers sell of each part: few users, many items."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("user"), F.col("l_partkey").alias("item"))
        .agg(_rating())
    )


def raw_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings with names in place of ids, and the order they were written in."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.join(orders, "l_orderkey").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("raw_user"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("raw_item"),
        (F.col("l_quantity") / 10).alias("rating"),
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey",
    )


def baskets_brand(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct brands of every order: ``basket, items``."""
    return (
        table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
        .join(_brands(spark, folder), "l_partkey")
        .groupBy(F.col("l_orderkey").alias("basket"))
        .agg(F.array_sort(F.collect_set("brand")).alias("items"))
    )


def basket_cells_brand(spark: SparkSession, folder: str) -> DataFrame:
    """The same in long form: ``basket, item``, each pair once."""
    return (
        table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
        .join(_brands(spark, folder), "l_partkey")
        .select(F.col("l_orderkey").alias("basket"), F.col("brand").alias("item"))
        .distinct()
    )
