"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits the vectors again and again at the median of a random projection;
vectors near the median go to both sides (spill).  The upper levels are fitted on a
bounded sample, leaves that are still too large are split again, each fitted on a
bounded sample of its own.  Vectors are compared with all others of their leaves in
every tree, by the exact cosine.

Nothing is kept per pair: a leaf returns how many links each vector has and, for
its connected groups, a link from every vector to the group's smallest.  A pair
that meets in several leaves is counted in the first of them only.  Equal vectors
are one node with a weight.  A node, on any level, of whose pairs more than a quarter
link is not split, as that would lose links, but compared in tiles: a median always
cuts a group that is more than half of its node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.components import components, spanned
from ratingloom.llm.rows import as_array
from ratingloom.session import stage

TREES = 8
#: Share of a node's vectors that go to both sides.
SPILL = 0.1
#: Vectors that one fit looks at, at most.
FIT_VECTORS = 1 << 14
#: Vectors of a leaf that trees aim at, and beyond which a leaf is split again.
LEAF, LEAF_MOST = 128, 4096
#: Levels of one fit.
LEVELS = 9
#: Share of linking pairs beyond which a node is not split, judged on so many vectors at least and at most.
TIGHT, TIGHT_LEAST, TIGHT_MOST = 0.25, 16, 512
#: Rows of a tile.
TILE = 2048


def _directions(seed: int, levels: int, width: int) -> np.ndarray:
    rng = np.random.default_rng(seed & (2**63 - 1))
    return rng.standard_normal((levels, width))


def _is_tight(unit: np.ndarray, bound: float) -> bool:
    """Whether more than :data:`TIGHT` of the pairs of a sample link."""
    n = len(unit)
    if n < TIGHT_LEAST:
        return False
    some = unit[np.linspace(0, n - 1, TIGHT_MOST).astype(int)] if n > TIGHT_MOST else unit
    linked = int((some @ some.T >= bound).sum()) - len(some)
    return linked > TIGHT * len(some) * (len(some) - 1)


def fit_tree(vectors: np.ndarray, seed: int, levels: int, spill: float, bound: float) -> np.ndarray:
    """Lower and upper bound of the spill zone of every inner node, level by level; NaN where a tight node stays whole."""
    bounds = np.zeros((2**levels - 1, 2))
    members = {0: np.arange(len(vectors))}
    for level, direction in enumerate(_directions(seed, levels, vectors.shape[1])):
        shade = vectors @ direction
        for node in range(2**level - 1, 2 ** (level + 1) - 1):
            own = members.pop(node, np.zeros(0, int))
            if _is_tight(vectors[own], bound):
                bounds[node] = np.nan
                continue
            if len(own):
                bounds[node] = np.quantile(shade[own], [0.5 - spill / 2, 0.5 + spill / 2])
            members[2 * node + 1], members[2 * node + 2] = own[shade[own] <= bounds[node, 1]], own[shade[own] >= bounds[node, 0]]
    return bounds


def route(vectors: np.ndarray, bounds: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, the nodes they end in, and whether those are tight; a row in the spill zone has several."""
    levels = (len(bounds) + 1).bit_length() - 1
    rows, nodes = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
    ended = []
    for direction in _directions(seed, levels, vectors.shape[1]):
        stays = np.isnan(bounds[nodes, 0])
        ended.append((rows[stays], nodes[stays]))
        rows, nodes = rows[~stays], nodes[~stays]
        shade = (vectors @ direction)[rows]
        left, right = shade <= bounds[nodes, 1], shade >= bounds[nodes, 0]
        rows, nodes = np.concatenate((rows[left], rows[right])), np.concatenate((2 * nodes[left] + 1, 2 * nodes[right] + 2))
    tight = sum(len(r) for r, _ in ended)
    every, at = (np.concatenate(a) for a in zip(*ended, (rows, nodes)))
    return every, at, np.arange(len(every)) < tight


def _unit(blobs: pd.Series) -> np.ndarray:
    matrix = np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``vec_id, shape`` of the usable rows, and ``node, weight, shape, vector`` per distinct vector."""
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(~odd)
    usable = usable.filter(F.exists(x, lambda v: v != 0))
    exact = F.transform(x, lambda v: v.cast("double") + F.lit(0.0))

    def as_blobs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            blobs = [np.asarray(v, "<f8").tobytes() for v in frame["embedding"]]
            yield pd.DataFrame({"vec_id": frame["vec_id"], "shape": frame["size"], "vector": blobs})

    rows = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("size"), exact.alias("embedding"))
    rows = stage(rows.mapInPandas(as_blobs, "vec_id long, shape int, vector binary"), "forest-vectors")
    nodes = rows.groupBy("shape", "vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"))
    return rows, nodes


def _memberships(nodes: DataFrame, bound: float, trees: int, spill: float, leaf: int, most: int, seed: int) -> DataFrame:
    """``leaf, node``: the leaves of every node in all trees; vectors of other lengths get leaves of their own."""
    spark = nodes.sparkSession
    count = nodes.count()
    levels = max(0, min(LEVELS, int(np.ceil(np.log2(max(1, count / leaf))))))
    # Bounded by FIT_VECTORS.
    sample = nodes.orderBy(F.xxhash64("node"), "shape").limit(FIT_VECTORS).select("shape", "vector").collect()
    fitted = {}
    for shape in {r["shape"] for r in sample}:
        unit = _unit(pd.Series([r["vector"] for r in sample if r["shape"] == shape]))
        fitted[shape] = [fit_tree(unit, seed + t, levels, spill, bound) for t in range(trees)]

    def top(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shape, part in frame.groupby("shape"):
                unit, own = _unit(part["vector"]), part["node"].to_numpy()
                for t, bounds in enumerate(fitted.get(shape, [np.zeros((0, 2))] * trees)):
                    rows, leaves, tight = route(unit, bounds, seed + t)
                    names = (np.int64(shape) << 40) + (t << 20) + leaves
                    yield pd.DataFrame({"leaf": names, "node": own[rows], "tight": tight})

    parts = nodes.select("node", "shape", "vector").mapInPandas(top, "leaf long, node long, tight boolean")
    parts = stage(parts, "forest-leaves")
    done = [parts.filter("tight").drop("tight")]
    found = parts.filter("not tight").drop("tight")
    while True:
        sizes = found.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > most)
        sizes = stage(sizes, "forest-large")
        if sizes.isEmpty():
            break
        done.append(found.join(sizes, "leaf", "left_anti"))
        large = found.join(sizes, "leaf").join(nodes.select("node", "vector"), "node")
        large = stage(large.select("leaf", "node", "size", "vector"), "forest-split")
        drawn = large.filter(F.abs(F.xxhash64("node", "leaf") % 1_000_000) < F.lit(1_000_000.0 * FIT_VECTORS / 2) / F.col("size"))

        def fit(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("node")
            unit, name, size = _unit(group["vector"]), int(group["leaf"].iloc[0]), int(group["size"].iloc[0])
            deep = max(1, min(6, int(np.ceil(np.log2(size / leaf)))))
            return pd.DataFrame({"leaf": [name], "bounds": [fit_tree(unit, name, deep, spill, bound).tobytes()]})

        def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for name, part in frame.groupby("leaf"):
                    bounds = as_array(part["bounds"].iloc[0], "<f8").reshape(-1, 2)
                    rows, leaves, tight = route(_unit(part["vector"]), bounds, int(name))
                    # A name of its own for every part; the shift keeps it apart from upper leaves.
                    with np.errstate(over="ignore"):
                        names = np.int64(name) * np.int64(1_000_003) + leaves + 1
                    yield pd.DataFrame({"leaf": names, "node": part["node"].to_numpy()[rows], "tight": tight})

        models = stage(drawn.groupBy("leaf").applyInPandas(fit, "leaf long, bounds binary"), "forest-fits")
        parts = large.join(models, "leaf").mapInPandas(split, "leaf long, node long, tight boolean")
        parts = stage(parts, "forest-leaves")
        done.append(parts.filter("tight").drop("tight"))
        found = parts.filter("not tight").drop("tight")
    for part in done:
        found = found.unionByName(part)
    return found


def _compared(nodes: DataFrame, leaves: DataFrame, bound: float, tile: int) -> DataFrame:
    """``node, links, root`` per leaf: links first met there, and a link into the leaf's group."""
    every = leaves.groupBy("node").agg(F.sort_array(F.collect_set("leaf")).alias("all_leaves"))
    described = stage(nodes.join(every, "node").select("node", "weight", "vector", "all_leaves"), "forest-nodes")
    sizes = leaves.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    placed = leaves.join(sizes, "leaf")
    mine = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    placed = placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select(
        "leaf", "node", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "mine"
    )

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        leaf, one, two = int(group["leaf"].iloc[0]), int(group["one"].iloc[0]), int(group["two"].iloc[0])
        group = group.sort_values(["mine", "node"], kind="stable")
        matrix = np.frombuffer(b"".join(group["vector"]), "<f8").reshape(len(group), -1)
        norms = np.linalg.norm(matrix, axis=1)
        ids, weights = group["node"].to_numpy(), group["weight"].to_numpy()
        most = max(len(a) for a in group["all_leaves"])
        lists = np.full((len(group), most), np.iinfo(np.int64).max)
        for k, a in enumerate(group["all_leaves"]):
            lists[k, : len(a)] = a
        mine = group["mine"].to_numpy()
        links = np.zeros(len(group), np.int64)
        lefts, rights = [], []
        for at in range(0, len(group), 512):
            near = matrix[at : at + 512] @ matrix.T >= bound * norms[at : at + 512, None] * norms
            i, j = np.nonzero(near)
            i += at
            keep = i < j
            if one != two:
                keep &= mine[i] != mine[j]
            i, j = i[keep], j[keep]
            lefts.append(i)
            rights.append(j)
            for part in range(0, len(i), 1 << 16):
                a, b = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                first = np.ones(len(a), bool)
                for k in range(most):
                    earlier = lists[a, k]
                    check = np.flatnonzero(first & (earlier < leaf))
                    if not len(check):
                        break
                    first[check] = ~(lists[b[check]] == earlier[check, None]).any(1)
                np.add.at(links, a[first], weights[b[first]])
                np.add.at(links, b[first], weights[a[first]])
        i, j = np.concatenate(lefts), np.concatenate(rights)
        linked, first = spanned(i, j, len(group))
        # The smallest id of each group stands for it.
        roots = np.full(len(group), np.iinfo(np.int64).max)
        np.minimum.at(roots, first, ids[linked])
        return pd.DataFrame({"node": ids[linked], "links": links[linked], "root": roots[first]})

    return (
        placed.join(described, "node").groupBy("leaf", "one", "two").applyInPandas(compared, "node long, links long, root long")
    )


def near_vectors(
    vectors: DataFrame,
    bound: float = 0.9,
    trees: int = TREES,
    spill: float = SPILL,
    leaf: int = LEAF,
    most: int = LEAF_MOST,
    tile: int = TILE,
    seed: int = 17,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (``vec_id, embedding``).

    Vectors link when a tree brings them together and their cosine reaches ``bound``; equal
    vectors always link.  Null or zero vectors and those with null or non-finite
    components link with nothing, and vectors of different lengths do not link.  Rows with
    one id are vectors of their own that share a component if any of them is linked; a
    null id gets a null component.  An empty table gives no rows.  Other
    columns are ignored.
    """
    rows, nodes = distinct_vectors(vectors)
    nodes = stage(nodes, "forest-distinct")
    leaves = stage(_memberships(nodes, bound, trees, spill, leaf, most, seed), "forest-members")
    found = stage(_compared(nodes, leaves, bound, tile), "forest-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("others"))
    links = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    labels = components(links)
    known = nodes.join(counts, "node", "left").join(labels, "node", "left").select(
        "shape", "vector", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    judged = rows.join(known, ["shape", "vector"]).select("vec_id", "n_links", "component_id")
    judged = judged.select(F.col("vec_id").alias("_id"), "n_links", "component_id")
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & ~odd & F.exists(x, lambda v: v != 0)
    alone = vectors.filter(~F.coalesce(usable, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id")
    )
    return judged.unionByName(alone).select(
        F.col("_id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
