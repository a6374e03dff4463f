"""Reproducible splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.functions.numeric import hash_percent, hash_text
from ratingloom.operators.index import dense_index

SEED = 42
_BUCKET_DIGITS = 4  # 16**4 hash buckets


def split_ratings(
    ratings: DataFrame, train_rate: int, seed: int = SEED, keys: tuple[str, ...] = ("user", "item")
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows.  A row's side depends on its keys and the seed alone."""
    side = hash_percent(*keys, seed=seed) < train_rate
    return ratings.filter(side), ratings.filter(~side)


def sample_rows(
    rows: DataFrame, position: str, first: int, n: int, seed: int = SEED, check: bool = False
) -> DataFrame:
    """Exactly ``n`` of the first ``first`` rows, without replacement.

    ``position`` numbers the rows from 0.  The rows with the ``n`` smallest hashes
    are taken: a histogram of hash prefixes shows which prefixes are taken whole,
    and only the rows of the one prefix that is cut are ranked.  ``check``
    fails when there are fewer than ``first`` rows.
    """
    if check and rows.count() < first:
        raise ValueError(f"fewer than {first} rows")
    head = rows.filter(F.col(position) < first).withColumn("_hash", hash_text(position, seed=seed))
    head = head.withColumn("_bucket", F.substring("_hash", 1, _BUCKET_DIGITS))
    # At most 16**4 rows, whatever the data: safe for one task and a broadcast.
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        head.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_upto", F.sum("_rows").over(upto))
        .filter(F.col("_upto") - F.col("_rows") < n)
        .select("_bucket", "_upto", (F.lit(n) - F.col("_upto") + F.col("_rows")).alias("_quota"))
    )
    near = head.join(F.broadcast(cuts), "_bucket")
    whole = near.filter(F.col("_upto") <= n).select(*rows.columns)
    cut = (
        dense_index(near.filter(F.col("_upto") > n), ["_hash", position], "_rank")
        .filter(F.col("_rank") < F.col("_quota"))
        .select(*rows.columns)
    )
    return whole.union(cut)


def in_order(sample: DataFrame, position: str | Column) -> DataFrame:
    """The sample in its original order."""
    return sample.orderBy(position)
