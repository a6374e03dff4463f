"""Level-wise frequent itemsets and items related through them.

Baskets come in long form, ``basket, item`` with integer ids and each pair once,
optionally with a ``weight`` that is constant within a basket.  Itemsets go out
as ``items`` (sorted array), ``size`` and ``freq``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.basket import require_unique, unique_items
from ratingloom.operators.fpgrowth import GROUP_CELLS, weighted_fp
from ratingloom.operators.gram import pair_products, symmetric
from ratingloom.operators.index import dense_index
from ratingloom.operators.vertical import count_sets, item_bitmaps
from ratingloom.session import stage

#: Items of a basket up to which each of them may carry the greater ones.
LONG_BASKET = 256


def basket_cells(baskets: DataFrame, duplicates: str = "drop") -> DataFrame:
    """Array baskets in long form.  ``duplicates``: ``drop`` or ``error``."""
    rule = {"drop": unique_items, "error": require_unique}[duplicates]
    carried = [c for c in ("basket", "weight") if c in baskets.columns]
    return baskets.select(*carried, F.explode(rule(F.col("items"))).alias("item"))


def item_frequency(cells: DataFrame) -> DataFrame:
    """Baskets (or basket weight) per item: ``item, freq``."""
    weight = F.col("weight") if "weight" in cells.columns else F.lit(1)
    return cells.groupBy("item").agg(F.sum(weight).cast("long").alias("freq"))


def support_rank(frequency: DataFrame, start: int = 0) -> DataFrame:
    """Items numbered by descending frequency, ties by item: ``item, freq, rank``."""
    return dense_index(frequency, [F.desc("freq"), F.asc("item")], "rank", start)


def collapse_baskets(baskets: DataFrame) -> DataFrame:
    """Identical baskets as one, with their number: ``items, weight``."""
    return baskets.groupBy(F.array_sort("items").alias("items")).agg(
        F.count(F.lit(1)).alias("weight")
    )


def enough(freq: Column, min_count: int, strict: bool) -> Column:
    """The support threshold, inclusive unless ``strict``."""
    return freq > min_count if strict else freq >= min_count


def frequent_pairs(cells: DataFrame, min_count: int, strict: bool = True, **kernel) -> DataFrame:
    """Frequent single items and pairs, the result of the one-pass job."""
    singles, kept = _frequent_cells(cells, min_count, strict)
    pairs = _pairs(kept, min_count, strict, **kernel)
    return _single_sets(singles).union(pairs)


def frequent_levels(
    cells: DataFrame, min_count: int, max_size: int | None = None, vertical: bool = False, **kernel
) -> Iterator[DataFrame]:
    """Yield the frequent itemsets of size 1, 2, ... until a level is empty.

    Each level is staged, so the next one starts from a table and not from the
    whole history.  Sizes above two only ever extend sets that are known to be
    in a basket by an item that completes a candidate: no basket is expanded
    into its combinations, and the join key is the itemset, not the basket.  With
    ``vertical`` they are counted on bitmaps of baskets instead (``vertical.py``), which
    writes no occurrences; a bitmap cannot count weighted baskets.
    """
    singles, kept = _frequent_cells(cells, min_count, strict=False)
    if singles.isEmpty():
        return
    yield _single_sets(singles)
    if max_size == 1:
        return
    level = stage(_pairs(kept, min_count, strict=False, **kernel), "level2")
    pairs = level.select(
        F.slice("items", 1, 1).alias("prefix"), F.element_at("items", 2).alias("item"), "items"
    )
    found, bitmaps = None, None
    vertical = vertical and "weight" not in cells.columns
    size = 2
    while not level.isEmpty():
        yield level
        if size == max_size:
            return
        size += 1
        candidates = stage(_candidates(level, size), f"candidates{size}")
        if candidates.isEmpty():
            return
        if vertical:
            if bitmaps is None:
                bitmaps = stage(item_bitmaps(kept), "bitmaps")
            counts = count_sets(bitmaps, candidates, size).filter(F.col("freq") >= min_count)
            kind = level.schema["items"].dataType
            counts = counts.select(F.col("items").cast(kind).alias("items"), F.lit(size).cast("long").alias("size"), "freq")
            level = stage(counts, f"level{size}")
            continue
        # Only sets that some candidate extends have to be known where they occur.
        extended = candidates.select(F.col("prefix").alias("items")).distinct()
        if found is None:
            first = pairs.join(extended, "items", "left_semi")
            found = [_occurrences(f, first, kept) for f in _singly(kept)]
        else:
            found = [f.join(extended, "items", "left_semi") for f in found]
        found = [_occurrences(f, candidates, kept) for f in found]
        if size != max_size:
            found = [stage(f, f"found{size}") for f in found]
        every = reduce(DataFrame.unionByName, [f.drop("rest") for f in found])
        level = stage(_counted(every, size, min_count), f"level{size}")


def frequent_itemsets(cells: DataFrame, min_count: int, max_size: int | None = None, **kernel) -> DataFrame:
    """All frequent itemsets up to ``max_size`` items."""
    found = None
    for level in frequent_levels(cells, min_count, max_size, **kernel):
        found = level if found is None else found.union(level)
    if found is None:
        return _single_sets(item_frequency(cells).filter(F.lit(False)))
    return found


def apriori(cells: DataFrame, min_count: int, max_iterations: int, **kernel) -> Iterator[DataFrame]:
    """The level-wise job: levels ``1 .. max_iterations - 1``."""
    if max_iterations <= 1:
        return iter(())
    return frequent_levels(cells, min_count, max_iterations - 1, **kernel)


def weighted_itemsets(baskets: DataFrame, min_support: float = 0.3, group_cells: int = GROUP_CELLS) -> DataFrame:
    """Itemsets with relative support, mined over collapsed baskets.

    Identical baskets are counted once with a weight before anything is mined.
    The threshold is ``floor(baskets * min_support)``, at least 1.  Items may be
    of any sortable type; they are numbered by support for the mining.
    """
    # The ids of collapsed baskets are drawn once, here; hence the staging.
    collapsed = stage(
        collapse_baskets(baskets.select("items")).withColumn("basket", F.monotonically_increasing_id()),
        "collapsed",
    )
    lines = collapsed.agg(F.sum("weight").alias("n")).first()["n"] or 0
    least = max(1, int(lines * min_support))
    raw = basket_cells(collapsed)
    ranks = stage(support_rank(item_frequency(raw).filter(F.col("freq") >= least)), "ranks")
    numbered = raw.join(ranks.select("item", "rank"), "item").groupBy("basket").agg(
        F.array_sort(F.collect_list("rank")).alias("items"), F.first("weight").alias("weight")
    )
    mined = weighted_fp(numbered, least, group_cells)
    names = ranks.select(F.col("rank").alias("id"), F.col("item").alias("name"))
    return (
        mined.select("items", "size", "freq", F.explode("items").alias("id"))
        .join(names, "id")
        .groupBy("items", "size", "freq")
        .agg(F.array_sort(F.collect_list("name")).alias("named"))
        .select(
            F.col("named").alias("items"), "size", "freq",
            (F.col("freq") / F.lit(float(max(lines, 1)))).alias("support"),
        )
    )


def partners(itemsets: DataFrame) -> DataFrame:
    """``item, partner`` for every two items that share a frequent itemset.

    Every part of a frequent set is frequent, so the pairs say it all.  An item
    without a partner has one row with a null partner.
    """
    singles = itemsets.filter("size = 1").select(F.element_at("items", 1).alias("item"))
    pairs = itemsets.filter("size = 2").select(
        F.element_at("items", 1).alias("i"), F.element_at("items", 2).alias("j"), "freq"
    )
    both = symmetric(pairs, "freq").select(F.col("i").alias("item"), F.col("j").alias("partner"))
    return singles.join(both, "item", "left")


def related_items(itemsets: DataFrame) -> DataFrame:
    """``item, related``: each frequent item with the sorted set of its partners."""
    return partners(itemsets).groupBy("item").agg(
        F.array_sort(F.collect_set("partner")).alias("related")
    )


def _frequent_cells(cells: DataFrame, min_count: int, strict: bool) -> tuple[DataFrame, DataFrame]:
    singles = stage(item_frequency(cells).filter(enough(F.col("freq"), min_count, strict)), "level1")
    kept = stage(cells.join(singles.select("item"), "item", "left_semi"), "kept")
    return singles, kept


def _single_sets(singles: DataFrame) -> DataFrame:
    return singles.select(F.array("item").alias("items"), F.lit(1).cast("long").alias("size"), "freq")


def _pairs(kept: DataFrame, min_count: int, strict: bool, **kernel) -> DataFrame:
    weight = "weight" if "weight" in kept.columns else None
    counted = pair_products(
        kept.withColumn("one", F.lit(1.0)), "basket", "item", "one", weight=weight, keys=kept, **kernel
    )
    item_type = kept.schema["item"].dataType
    return (
        counted.select("i", "j", F.round("dot").cast("long").alias("freq"))
        .filter(enough(F.col("freq"), min_count, strict))
        .select(
            F.array(F.col("i").cast(item_type), F.col("j").cast(item_type)).alias("items"),
            F.lit(2).cast("long").alias("size"),
            "freq",
        )
    )


def _counted(occurrences: DataFrame, size: int, min_count: int) -> DataFrame:
    weight = F.col("weight") if "weight" in occurrences.columns else F.lit(1)
    return (
        occurrences.groupBy("items")
        .agg(F.sum(weight).cast("long").alias("freq"))
        .filter(F.col("freq") >= min_count)
        .select("items", F.lit(size).cast("long").alias("size"), "freq")
    )


def _candidates(level: DataFrame, size: int) -> DataFrame:
    """Sets of ``size`` items all of whose parts one smaller are frequent."""
    head = F.slice("items", 1, size - 2)
    first = level.select(head.alias("head"), F.element_at("items", -1).alias("a"))
    second = level.select(head.alias("head"), F.element_at("items", -1).alias("item"))
    joined = (
        first.join(second, "head")
        .filter(F.col("a") < F.col("item"))
        .select(
            F.concat("head", F.array("a")).alias("prefix"),
            "item",
            F.concat("head", F.array("a", "item")).alias("items"),
        )
    )
    for dropped in range(size - 2):
        part = F.concat(F.slice("items", 1, dropped), F.slice("items", dropped + 2, size))
        joined = (
            joined.withColumn("part", part)
            .join(level.select(F.col("items").alias("part")), "part", "left_semi")
            .drop("part")
        )
    return joined


def _singly(kept: DataFrame) -> list[DataFrame]:
    """Where the single items occur: in baskets of at most ``LONG_BASKET`` items, with the greater ones
    as ``rest``, and in longer baskets if there are any."""
    weight = [c for c in ("weight",) if c in kept.columns]
    sizes = kept.groupBy("basket").agg(F.count(F.lit(1)).alias("n"))
    longer = stage(sizes.filter(F.col("n") > LONG_BASKET).select("basket"), "long-baskets")
    none = longer.isEmpty()
    short = kept.filter("basket is not null") if none else kept.join(longer, "basket", "left_anti").filter("basket is not null")
    whole = short.groupBy("basket", *weight).agg(F.array_sort(F.collect_list("item")).alias("every"))
    found = whole.select("basket", *weight, "every", F.posexplode("every").alias("at", "item")).select(
        "basket", *weight, F.array("item").alias("items"), F.expr("slice(every, at + 2, size(every))").alias("rest")
    )
    if none:
        return [found]
    return [found, kept.join(longer, "basket", "left_semi").select("basket", *weight, F.array("item").alias("items"))]


def _occurrences(found: DataFrame, grown: DataFrame, kept: DataFrame) -> DataFrame:
    """Where the grown sets occur, from where their prefixes occur.

    With ``rest``, what a basket does not hold is dropped where it is made and never shuffled.  A long
    basket would be copied too often and is asked through a join.
    """
    tried = found.withColumnRenamed("items", "prefix").join(grown, "prefix")
    if "rest" in found.columns:
        here = tried.filter(F.array_contains("rest", F.col("item")))
    else:
        here = tried.join(kept.select("basket", "item"), ["basket", "item"], "left_semi")
    return here.drop("prefix", "item")
