"""Array expressions on baskets and itemsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_items(line: Column, item_type: str = "int", delimiter: str = ",") -> Column:
    """Split a delimited line and cast every field."""
    fields = F.split(line, delimiter, -1)
    if item_type == "string":
        return fields
    return F.transform(fields, lambda x: F.trim(x).cast(item_type))


def unique_items(items: Column) -> Column:
    """Drop repeated items."""
    return F.array_distinct(items)


def require_unique(items: Column) -> Column:
    """The items themselves; fails the query when one is repeated."""
    return F.when(
        F.size(items) != F.size(F.array_distinct(items)),
        F.raise_error(F.concat(F.lit("repeated item in basket: "), F.to_json(items))),
    ).otherwise(items)


def without(items: Column, item: Column) -> Column:
    """The set without one item."""
    return F.array_except(items, F.array(item))


def covers(basket: Column, candidate: Column) -> Column:
    """True when every item of ``candidate`` is in ``basket``."""
    return F.size(F.array_except(candidate, basket)) == 0


def joined(items: Column, delimiter: str = ",") -> Column:
    """Items as delimited text."""
    return F.concat_ws(delimiter, F.transform(items, lambda x: x.cast("string")))


def bracketed(items: Column) -> Column:
    """Items as ``[a, b, c]``."""
    return F.concat(F.lit("["), joined(items, ", "), F.lit("]"))
