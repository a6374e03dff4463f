"""Documents with nearly the same word shingles, by T-occurrence search.

A document is a set of shingle numbers.  Two sets link when their Jaccard similarity
reaches a bound of ``percent`` hundredths, so they share at least that part of the
larger one.  If ``n - T`` elements of a set of ``n`` may be missing in its partner,
then of its ``2 (n - T + 1)`` least elements at least ``n - T + 2`` are shared, and
they are among the least ones of one of the two.  Inverted lists are kept for these.

* Lists of at most ``SHORT`` documents are merged: every pair of the list is
  counted.  A document with ``L`` longer lists must meet a partner in at least
  ``n - T + 2 - L`` short ones; pairs below that are gone.
* Long lists are not merged (DivideSkip).  Two documents that meet in long lists only
  both have very many of them, as near copies in a large group do.  Of those
  documents' long lists, rarest first, so many are taken that such a pair must meet in
  one; each names its smallest document as a possible partner of all others.

These candidates are links of a graph; its components are compared on whole sets, in
tiles of bounded size, by the tile's own inverted lists.  Nothing is kept per pair: a
tile returns a link from every document to the smallest it is connected with.  Equal
sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.llm.components import components, spanned
from ratingloom.llm.rows import as_array, buckets_of, sized, tidied
from ratingloom.llm.words import fingerprint, grams, word_arrays
from ratingloom.session import stage

#: Lists up to this length are merged.
SHORT = 32
#: Postings of one bucket of lists, about.
BUCKET_POSTINGS = 1 << 19
#: Documents of a tile's side.
TILE = 256


def shingles_of(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingles in ascending order."""
    return np.unique(grams(words, width))


def _needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return -(-n * percent // 100)


def _spare(n: Column, percent: int) -> Column:
    """Of the listed elements, how many a partner must share at least."""
    missing = n - F.ceil(n * percent / 100)
    return F.least(n, 2 * (missing + 1)) - missing


def shingle_sets(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, n, print, least``: size, fingerprint and least elements of every document's set."""

    def described(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes, prints, least = [], [], []
            for words in word_arrays(frame["text"], lower=True):
                found = shingles_of(words, width)
                n = len(found)
                sizes.append(n)
                prints.append(fingerprint(found) if n else None)
                least.append(found[: 2 * (n - _needed(n, percent) + 1)].tobytes())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n": sizes, "print": prints, "least": least})

    chosen = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = chosen.mapInPandas(tidied(described), "doc_id string, n long, print binary, least binary")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def _merged(nodes: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Short lists as counted pairs (``kind`` 0: ``a, b, c, na, nb``), long ones as postings (``kind`` 1: ``a`` the list, ``b`` its document)."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = 0
            sizes = np.array([len(b) // 8 for b in frame["least"]])
            while at < len(frame):
                to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BUCKET_POSTINGS)))
                part, held = frame.iloc[at:to], sizes[at:to]
                numbers = as_array(b"".join(part["least"]), "<u8")
                owner = np.repeat(part["doc_id"].to_numpy(np.int64), held)
                size = np.repeat(part["n"].to_numpy(np.int32), held)
                route = buckets_of(numbers, buckets)
                order = np.argsort(route, kind="stable")
                cuts = np.searchsorted(route[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                out = {"bucket": full}
                for name, column in (("numbers", numbers), ("owners", owner), ("sizes", size)):
                    column = column[order]
                    out[name] = [column[cuts[b] : cuts[b + 1]].tobytes() for b in full]
                yield pd.DataFrame(out)
                at = to

    def lists(group: pd.DataFrame) -> pd.DataFrame:
        numbers = as_array(b"".join(group["numbers"]), "<u8")
        owner, size = as_array(b"".join(group["owners"]), "<i8"), as_array(b"".join(group["sizes"]), "<i4").astype(np.int64)
        order = np.lexsort((owner, numbers))
        numbers, owner, size = numbers[order], owner[order], size[order]
        first = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
        length = np.diff(np.append(first, len(numbers)))
        left, right = [np.zeros(0, int)], [np.zeros(0, int)]
        for k in range(2, SHORT + 1):
            begins = first[length == k]
            one, two = np.triu_indices(k, 1)
            left.append((begins[:, None] + one).ravel())
            right.append((begins[:, None] + two).ravel())
        a, b = np.concatenate(left), np.concatenate(right)
        near = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
        near &= owner[a] != owner[b]
        a, b = a[near], b[near]
        order = np.lexsort((owner[b], owner[a]))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.append(True, (owner[a][1:] != owner[a][:-1]) | (owner[b][1:] != owner[b][:-1]))[: len(a)])
        count = np.diff(np.append(new, len(a)))
        long = np.repeat(length > SHORT, length)
        pairs = pd.DataFrame({
            "kind": 0, "a": owner[a[new]], "b": owner[b[new]], "c": count, "na": size[a[new]], "nb": size[b[new]],
        })
        postings = pd.DataFrame({
            "kind": 1, "a": numbers[long].view(np.int64), "b": owner[long], "c": 1, "na": size[long], "nb": size[long],
        })
        return pd.concat([pairs, postings])

    sent = nodes.select("doc_id", "n", "least").mapInPandas(
        cut, "bucket int, numbers binary, owners binary, sizes binary"
    )
    return sent.groupBy("bucket").applyInPandas(lists, "kind int, a long, b long, c long, na long, nb long")


def _possible(lists: DataFrame, percent: int) -> DataFrame:
    """Candidate links ``a, b``: whoever links is connected by them."""
    postings = lists.filter("kind = 1").select(F.col("a").alias("list"), F.col("b").alias("doc"), F.col("na").alias("n"))
    long = stage(postings.groupBy("doc").agg(F.count(F.lit(1)).alias("long"), F.min("n").alias("n")), "join-long")
    merged = lists.filter("kind = 0").groupBy("a", "b").agg(
        F.sum("c").alias("c"), F.min("na").alias("na"), F.min("nb").alias("nb")
    )
    la = long.select(F.col("doc").alias("a"), F.col("long").alias("la"))
    lb = long.select(F.col("doc").alias("b"), F.col("long").alias("lb"))
    least = F.least(
        _spare(F.col("na"), percent) - F.coalesce("la", F.lit(0)), _spare(F.col("nb"), percent) - F.coalesce("lb", F.lit(0))
    )
    short = merged.join(la, "a", "left").join(lb, "b", "left").filter(F.col("c") >= least).select("a", "b")

    # A pair without a common short list shares at least as many long ones as the smallest possible partner must.
    must = _spare(F.ceil(F.col("n") * percent / 100), percent)
    full = long.withColumn("take", F.col("long") - must + 1).filter("take > 0").select("doc", "take")
    sizes = postings.groupBy("list").agg(F.count(F.lit(1)).alias("size"))
    ranked = postings.join(stage(full, "join-full"), "doc").join(sizes, "list")
    rarest = Window.partitionBy("doc").orderBy("size", "list")
    used = ranked.withColumn("turn", F.row_number().over(rarest)).filter("turn <= take").select("list", "doc")
    used = stage(used, "join-used")
    heads = used.groupBy("list").agg(F.min("doc").alias("a"))
    named = used.join(heads, "list").filter("doc <> a").select("a", F.col("doc").alias("b"))
    return short.unionByName(named).distinct()


def tile_links(sets: list[np.ndarray], groups: np.ndarray, sides: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that reach the bound: of one group, and of both sides if there are two."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, element, held = np.unique(every, return_inverse=True, return_counts=True)
    # Elements of one document only add nothing.
    shared = held[element] > 1
    element, owner = element[shared], owner[shared]
    order = np.argsort(element, kind="stable")
    lists = owner[order]
    starts = np.searchsorted(element[order], np.arange(len(held) + 1))
    bounds = np.searchsorted(owner, np.arange(len(sets) + 1))
    both_sides = len(np.unique(sides)) > 1
    left, right = [], []
    for a in range(len(sets)):
        own = element[bounds[a] : bounds[a + 1]]
        count = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        common = np.bincount(lists[at], minlength=len(sets))
        good = (100 * common >= percent * (sizes[a] + sizes - common)) & (groups == groups[a])
        good[: a + 1] = False
        if both_sides:
            good &= sides != sides[a]
        partners = np.flatnonzero(good)
        left.append(np.full(len(partners), a))
        right.append(partners)
    return np.concatenate(left), np.concatenate(right)


def _verified(documents: DataFrame, clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` that hold on whole sets and connect what is connected within ``clusters`` (``node, component``)."""
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    total = clusters.count()
    bundles = max(1, total // TILE)
    small = F.col("size") <= TILE
    tiles = F.when(small, 1).otherwise(F.ceil(F.col("size") / TILE)).cast("int")
    placed = clusters.join(sizes, "component").select(
        F.col("node").alias("doc_id"), "component",
        F.when(small, F.pmod(F.xxhash64("component"), F.lit(bundles))).otherwise(-1 - F.col("component")).alias("bundle"),
        tiles.alias("tiles"), F.pmod(F.xxhash64("node"), tiles).cast("int").alias("side"),
    )
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sized(stage(placed, "join-placed")), "doc_id")

    def described(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingles_of(w, width).tobytes() for w in word_arrays(frame["text"], lower=True)]
            yield frame.drop(columns="text").assign(elements=sets)

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["elements"].str.len() > 0].sort_values(["doc_id", "elements"], kind="stable")
        ids = group["doc_id"].to_numpy(np.int64)
        if len(ids) < 2:
            return pd.DataFrame({"a": ids[:0], "b": ids[:0]})
        sets = [as_array(e, "<u8") for e in group["elements"]]
        i, j = tile_links(sets, group["component"].to_numpy(), group["side"].to_numpy(), percent)
        # Rows come by id, so the first of each connected group is its smallest.
        linked, roots = spanned(i, j, len(ids))
        return pd.DataFrame({"a": ids[roots], "b": ids[linked]})

    found = chosen.mapInPandas(
        tidied(described), "doc_id long, component long, bundle long, tiles int, side int, elements binary"
    )
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = found.withColumn("other", other).select(
        "doc_id", "component", "bundle", "side", "elements",
        F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"),
    )
    return dealt.groupBy("bundle", "one", "two").applyInPandas(compared, "a long, b long").filter("a <> b")


def join(documents: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Words are lower-cased in A-Z.  A text of fewer than ``width`` words is one shingle;
    a null or empty text has none and links with nothing.  Rows with one ``doc_id``
    are one document that links wherever one of its texts does; a null id links
    with nothing and gets a null component.  Equal similarities need no rule, the
    bound is inclusive.  An empty table gives no rows.  Other columns are ignored.
    """
    spark = documents.sparkSession
    sets = stage(shingle_sets(documents, width, percent), "join-profiles")
    usable = sets.filter("doc_id is not null and n > 0")
    classes = stage(usable.groupBy("print").agg(F.min("doc_id").alias("node")), "join-classes")
    heads = sized(classes.select(F.col("node").alias("doc_id"), "print"))
    nodes = usable.join(heads, ["doc_id", "print"], "left_semi").select("doc_id", "n", "least")
    postings = sets.agg(F.coalesce(F.sum(F.length("least")), F.lit(0)).alias("n")).first()["n"] // 8
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), postings // BUCKET_POSTINGS)
    lists = stage(_merged(nodes, parts, percent), "join-lists")
    possible = stage(_possible(lists, percent), "join-possible")
    clusters = stage(components(possible), "join-clusters")
    links = _verified(documents, clusters, width, percent)
    # Documents whose texts fall into several classes join them.
    several = usable.join(classes, "print").filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    owned = classes.select(F.col("node").alias("a")).distinct()
    labels = components(links.unionByName(several.join(owned, "a").select("a", "b")))
    placed = sets.select("doc_id", "n", "print").join(classes, "print", "left").join(labels, "node", "left")
    return placed.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"),
    )
