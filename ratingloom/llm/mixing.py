"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source gets a share of the wanted words by weight, at most ``most_repeats``
times its own size; what a capped source cannot take is shared again by weight.
The shares are handed out as blocks of ``block_words`` words, by highest quotients
vote / (2 * seats + 1): first among sources, then among the groups of shards of a
source, then among the shards of a group.  A shard is a bounded part of a
source, its documents in a seeded order, cut into blocks without regard to where
documents end.  Every shard takes all its blocks as often as its quota allows and
one more time those that come first in a seeded order of blocks.

Only DataFrame functions are used.  No group is unbounded: a source's words are
spread over shards, and only per-shard rows are ranked within a group of shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.llm.rows import digest, digest_number
from ratingloom.session import stage

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def count_words(text: Column) -> Column:
    """Number of words in a text; none in a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most_repeats: int) -> DataFrame:
    """``source, source_size`` with ``target``, the words that the mix wants of each source.

    Weights go to sources in code-point order (null last), repeating.  Sources
    are capped in the order of cap over weight: one is capped if the level that
    the rest would reach lies above its cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("place", F.row_number().over(by_name))
    options = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(options, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * most_repeats)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "place")
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ranked = ranked.withColumn("level", left / F.sum("weight").over(onwards))
    # The first source that stays under its cap fixes the level of all after it.
    ranked = ranked.withColumn("free", F.col("cap") >= F.col("level") * F.col("weight"))
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(by_ratio)
    target = F.coalesce(F.least(level * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return ranked.select("source", "source_size", "place", target.alias("target"))


def sainte_lague(parts: DataFrame, group: list[str], key: list[str], vote: str, seats: str, out: str) -> DataFrame:
    """Add ``out``: how many of the group's ``seats`` each part gets by highest quotients.

    With ``n`` parts, a part's seats differ from its rounded quota by at most half of
    ``n`` times its share, plus one.  Only quotients in that range are ranked, five
    times ``n`` at most; those below it are certain.  Ties go by ``key``.
    """
    whole = Window.partitionBy(*group)
    votes = F.sum(vote).over(whole)
    share = F.when(votes > 0, F.col(vote) / votes).otherwise(F.lit(0.0))
    quota = F.floor(F.col(seats) * share + 0.5)
    slack = F.ceil(F.count(F.lit(1)).over(whole) * share / 2) + 1
    ranged = parts.withColumn("_low", F.greatest(quota - slack, F.lit(0))).withColumn("_high", quota + slack)
    ranged = ranged.withColumn("_open", F.col(seats) - F.sum("_low").over(whole))
    rows = ranged.withColumn("_seat", F.explode(F.sequence(F.col("_low"), F.col("_high"))))
    quotient = F.col(vote) / (F.col("_seat") * 2 + 1)
    best = Window.partitionBy(*group).orderBy(quotient.desc(), *key)
    won = (F.row_number().over(best) <= F.col("_open")) & (F.col(vote) > 0)
    columns = parts.columns
    return (
        rows.withColumn("_won", won.cast("long"))
        .groupBy(*columns)
        .agg((F.first("_low") + F.sum("_won")).alias(out))
    )


def _drawn(
    sized: DataFrame,
    weights: tuple[int, ...],
    share: float,
    most_repeats: int,
    block_words: int,
    shard_words: int,
    group_shards: int,
    seed: int,
) -> tuple[DataFrame, DataFrame]:
    """The sources with their targets, and ``row, start, block, inside, times`` of every block's part of a row.

    ``sized``, a written table, has ``row, doc_id, source, size``; ``start`` is the row's first word in its shard.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, share, most_repeats)
    blocks = F.floor(F.sum("target").over(Window.partitionBy()) / block_words + 0.5)
    targets = targets.withColumn("all_blocks", blocks)
    apportioned = sainte_lague(targets.withColumn("all", F.lit(0)), ["all"], ["place"], "target", "all_blocks", "blocks")
    apportioned = apportioned.withColumn("shards", F.ceil((F.col("source_size") + 1) / shard_words).cast("long"))
    apportioned = stage(apportioned.select("place", "source", "source_size", "target", "blocks", "shards"), "mix-sources")

    placed = sized.join(apportioned, sized["source"].eqNullSafe(apportioned["source"])).select(
        "row", "doc_id", "size", "place", (digest_number(seed, F.col("doc_id")) % F.col("shards")).alias("shard")
    )
    order = Window.partitionBy("place", "shard").orderBy(digest(seed, F.col("doc_id")), "doc_id", "size", "row")
    start = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = placed.withColumn("start", start)

    shards = placed.groupBy("place", "shard").agg(F.sum("size").alias("words"))
    shards = shards.withColumn("part", F.floor(F.col("shard") / group_shards))
    parts = shards.groupBy("place", "part").agg(F.sum("words").alias("part_words"))
    parts = parts.join(apportioned.select("place", "blocks"), "place")
    parts = sainte_lague(parts, ["place"], ["part"], "part_words", "blocks", "part_blocks")
    shards = shards.join(parts.select("place", "part", "part_blocks"), ["place", "part"])
    shards = sainte_lague(shards, ["place", "part"], ["shard"], "words", "part_blocks", "quota")
    has = F.ceil(F.col("words") / block_words)
    quota = F.least(F.col("quota"), has * most_repeats)
    shards = shards.withColumn("has", has).withColumn("quota", quota).filter("words > 0")
    shards = shards.select(
        "place", "shard", F.floor(F.col("quota") / F.col("has")).alias("every"), (F.col("quota") % F.col("has")).alias("extra")
    )

    spans = placed.filter("size > 0").withColumn(
        "block",
        F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))),
    )
    drawn = Window.partitionBy("place", "shard").orderBy(digest(seed, F.col("place"), F.col("shard"), F.col("block")), "block")
    first = F.greatest(F.col("start"), F.col("block") * block_words)
    last = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    spans = spans.select(
        "row", "place", "shard", "start", "block", (last - first).alias("inside"), F.dense_rank().over(drawn).alias("turn")
    )
    times = F.col("every") + F.when(F.col("turn") <= F.col("extra"), 1).otherwise(0)
    spans = spans.join(shards, ["place", "shard"])
    return apportioned, spans.select("row", "start", "block", "inside", times.alias("times"))


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most_repeats: int = 2,
    block_words: int = 32,
    shard_words: int = 1 << 16,
    group_shards: int = 1 << 12,
    seed: int = 7,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, block_quota`` for every row.

    ``taken`` counts words, repeats included, at most ``most_repeats`` times ``size``.
    Nulls: a null text has size 0, a null source is a source of its own, a null
    ``doc_id`` is an id like any other.  Rows repeated in full are rows of their
    own.  A document without words takes none; an empty table gives no rows.
    Other columns are ignored.
    """
    sized = documents.select("doc_id", "source", count_words(F.col("text")).alias("size"))
    # The row number only names a row of this written table; results do not depend on it.
    sized = stage(sized.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    apportioned, spans = _drawn(sized, weights, share, most_repeats, block_words, shard_words, group_shards, seed)
    taken = spans.groupBy("row").agg(F.sum(F.col("inside") * F.col("times")).cast("long").alias("taken"))
    named = sized.join(
        apportioned.select(F.col("source").alias("_source"), "source_size", "target", "blocks"),
        F.col("source").eqNullSafe(F.col("_source")),
    )
    return named.join(taken, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("blocks").alias("block_quota"),
    )


def mixed_texts(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most_repeats: int = 2,
    block_words: int = 32,
    shard_words: int = 1 << 16,
    group_shards: int = 1 << 12,
    seed: int = 7,
) -> DataFrame:
    """``documents`` with each ``text`` made of exactly the blocks that :func:`mix` draws of its row.

    The drawn blocks follow in their order, with the white space behind their words;
    those drawn again follow once more, after a space.  A text that is drawn whole is
    left as it is.  Rows of which nothing is drawn go.  Nulls and repeated rows are
    taken as in :func:`mix`, row by row.
    """
    # The row number only names a row of this written table.
    rows = stage(documents.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    sized = stage(rows.select(F.col("_row").alias("row"), "doc_id", "source", count_words(F.col("text")).alias("size")), "mix-sizes")
    _, spans = _drawn(sized, weights, share, most_repeats, block_words, shard_words, group_shards, seed)
    drawn = spans.groupBy(F.col("row").alias("_row")).agg(
        (F.first("start") % block_words).alias("_ahead"), F.max("times").alias("_most"), F.min("times").alias("_least"),
        F.sort_array(F.collect_list(F.struct("block", "times"))).alias("_blocks"),
    )
    joined = rows.join(drawn.filter("_most > 0"), "_row")
    words = F.regexp_extract_all("text", F.lit(WORD_PATTERN + r"[\x20\x09-\x0D]*"), F.lit(0))

    def taken(turn: Column) -> Column:
        def is_drawn(_: Column, at: Column) -> Column:
            return F.get("_blocks", F.floor((F.col("_ahead") + at) / block_words).cast("int"))["times"] >= turn

        return F.when(turn <= F.col("_least"), F.col("text")).otherwise(F.array_join(F.filter(words, is_drawn), ""))

    turns = F.transform(F.sequence(F.lit(1).cast("long"), F.col("_most").cast("long")), taken)
    return joined.withColumn("text", F.array_join(turns, " ")).select(documents.columns)
