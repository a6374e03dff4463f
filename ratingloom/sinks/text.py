"""The line formats of results, each as a one-column DataFrame, and their writer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.basket import bracketed, joined


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a one-column text table."""
    lines.write.mode(mode).text(path)


def _line(*parts: Column) -> Column:
    return F.concat(*[p.cast("string") for p in parts]).alias("value")


def recommendation_lines(ranked: DataFrame) -> DataFrame:
    """``user:(item,score),(item,score)``, best first."""
    entry = _line(F.lit("("), F.col("item"), F.lit(","), F.col("score"), F.lit(")"))
    best_first = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"))))
    return ranked.groupBy("user").agg(best_first.alias("best")).select(
        _line(F.col("user"), F.lit(":"), F.concat_ws(",", F.col("best.entry")))
    )


def counted_itemset_lines(itemsets: DataFrame) -> DataFrame:
    """``count:a,b,c``."""
    return itemsets.select(_line(F.col("freq"), F.lit(":"), joined(F.col("items"))))


def itemset_lines(itemsets: DataFrame) -> DataFrame:
    """``a,b``."""
    return itemsets.select(joined(F.col("items")).alias("value"))


def write_levels(levels: Iterable[DataFrame], output: str) -> int:
    """Each level as ``[a, b]`` lines in its own folder ``output/k``; returns the number of levels."""
    size = 0
    for size, level in enumerate(levels, start=1):
        write_lines(level.select(bracketed(F.col("items")).alias("value")), f"{output}/{size}")
    return size


def support_lines(itemsets: DataFrame) -> DataFrame:
    """``a,b:support`` with the size to partition by."""
    return itemsets.select("size", _line(joined(F.col("items")), F.lit(":"), F.col("support")))


def write_by_size(lines: DataFrame, path: str) -> None:
    """One folder per itemset size."""
    lines.write.partitionBy("size").text(path)


def related_lines(related: DataFrame) -> DataFrame:
    """``item:a,b,c``."""
    return related.select(_line(F.col("item"), F.lit(":"), joined(F.col("related"))))


def rating_lines(ratings: DataFrame) -> DataFrame:
    """``user,item,rating``."""
    return ratings.select(_line(F.col("user"), F.lit(","), F.col("item"), F.lit(","), F.col("rating")))


def id_map_lines(ids: DataFrame) -> DataFrame:
    """``raw,idx``."""
    return ids.select(_line(F.col("raw"), F.lit(","), F.col("idx")))


def sparse_row_lines(cells: DataFrame) -> DataFrame:
    """``item:value,item:value,`` by ascending item; also keeps the user."""
    entry = F.concat(F.col("item").cast("string"), F.lit(":"), F.col("rating").cast("string"), F.lit(","))
    row = F.array_sort(F.collect_list(F.struct("item", entry.alias("entry"))))
    return cells.groupBy("user").agg(row.alias("row")).select(
        "user", F.concat_ws("", F.col("row.entry")).alias("value")
    )


def dense_rows(scores: DataFrame) -> DataFrame:
    """Rows of a full matrix: ``row, values`` by ascending item."""
    cells = F.array_sort(F.collect_list(F.struct("item", "score")))
    return scores.groupBy(F.col("user").alias("row")).agg(cells.alias("cells")).select(
        "row", F.col("cells.score").alias("values")
    )
