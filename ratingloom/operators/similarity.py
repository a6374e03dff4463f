"""Exact cosine between the columns of a rating matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.numeric import half_scale
from ratingloom.operators.cells import transpose
from ratingloom.operators.gram import pair_products, squared_norms, symmetric
from ratingloom.session import stage


#: Norms of up to so many items (16 bytes each) are sent to every executor.
NORMS_TO_ALL = 2_000_000


def item_cosine(cells: DataFrame, **kernel) -> DataFrame:
    """Cosine of every pair of items with a common user: ``i < j, sim``.

    The (much longer) pair table is never shuffled to meet the norms.  Up to
    ``NORMS_TO_ALL`` items, counted first, they come to the sums, and the kernel moves plain ratings,
    which repeat and so compress well.  Beyond, ratings are divided by their item's norm
    first, so the pair sums already are cosines.
    """
    norms = stage(squared_norms(cells, "item", "rating").select("i", F.sqrt("dot").alias("norm")), "norms")
    if norms.count() <= NORMS_TO_ALL:
        pairs = pair_products(cells, "user", "item", "rating", keys=cells, **kernel)
        for side in ("i", "j"):
            own = norms.select(F.col("i").alias(side), F.col("norm").alias(f"norm_{side}"))
            pairs = pairs.join(F.broadcast(own), side)
        cosine = F.col("dot") / (F.col("norm_i") * F.col("norm_j"))
        return pairs.filter(F.col("dot") != 0.0).select("i", "j", cosine.alias("sim")).filter(F.col("sim") != 0.0)
    unit = cells.join(norms.withColumnRenamed("i", "item"), "item").select(
        "user", "item", (F.col("rating") / F.col("norm")).alias("unit")
    )
    pairs = pair_products(unit, "user", "item", "unit", keys=cells, **kernel)
    return pairs.select("i", "j", F.col("dot").alias("sim")).filter(F.col("sim") != 0.0)


def user_cosine(cells: DataFrame, **kernel) -> DataFrame:
    """Cosine of every pair of users with a common item: ``i < j, sim``."""
    return item_cosine(transpose(cells), **kernel)


@dataclass(frozen=True)
class ItemCosine:
    """The cosines of items as a model that is not stored until somebody asks for the table.

    ``cells`` are the stored ratings that the cosines are made of.
    """

    cells: DataFrame

    def table(self) -> DataFrame:
        """The pairs of :func:`item_cosine`, stored once, so that their size is known to the joins."""
        return stage(item_cosine(self.cells), "cosine")


def similarity_table(cosine: DataFrame) -> DataFrame:
    """Both directions of a cosine table, rescaled to weights in [0, 1]."""
    return symmetric(cosine, "sim").withColumn("sim", half_scale(F.col("sim")))
