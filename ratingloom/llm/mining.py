"""Hard negatives by slot-decomposed selection.

Every positive of an anchor opens a window of scores in which its negatives lie: from
half its score up to 95 % of it.  The windows of one anchor overlap.  Their upper
limits cut the score axis into disjoint slots; every row of another label falls
into one slot, and a combiner keeps the best ``per_positive`` of each slot, in a task
first and then over all tasks.  Going down from a positive's own slot, the merged
slots below it hold the best rows under its limit, which answers all windows from
one selection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.llm.asking import Best, blocks, exact_kind, in_passes, matrix_of, norms, scaled, usable
from ratingloom.session import stage

#: Components are held within this bound, so that scores times twenty fit 64 bits up to 1,024 components.
MOST = 1 << 24


def labelled_parts(vectors: DataFrame, scale: int, noisy: int, labels: int) -> DataFrame:
    """``vec_id, label, parts`` of the rows that take part; ids that ``noisy`` divides get the next label."""
    chosen = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    label = F.col("label").cast("long")
    return chosen.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % noisy == 0, (label + 1) % labels).otherwise(label).alias("label"),
        scaled(F.col("embedding"), scale, MOST).alias("parts"),
    )


def slots_of(rows: np.ndarray, scores: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The slot of each score: 0 lies under the row's highest limit only, the last under all of them."""
    return (scores[:, None] <= limits[rows]).sum(1) - 1


def merged_slots(slots: list[list[tuple[int, int]]], n: int) -> list[list[tuple[int, int]]]:
    """The best ``n`` of each slot and all lower ones, each slot given as (-score, id) in order."""
    out: list[list[tuple[int, int]]] = []
    below: list[tuple[int, int]] = []
    for own in reversed(slots):
        below = (own + below)[:n]  # every score of a slot is above those of the lower ones
        out.append(below)
    return out[::-1]


def _scored(rows: DataFrame, anchors: DataFrame, groups: int, k: int, pick: Callable) -> DataFrame:
    """``anchor_id, slot, vec_id, score``: the best ``k`` of each anchor's groups, one selection a task.

    ``pick(anchors' rows, scores, same label)`` gives, for a block of anchors against
    a batch of vectors, the positions that count and their group.
    """
    columns = "anchor_id long, slot int, vec_id long, score long"

    def searched(part: pa.Table) -> DataFrame:
        asked = {c: part.column(c).to_numpy() for c in part.column_names if c not in ("parts", "limits")}
        asked["parts"] = matrix_of(part.column("parts").combine_chunks())
        if "limits" in part.column_names:
            # Fewer positives than groups: the missing limits lie below every score.
            limits = part.column("limits").combine_chunks()
            wide = matrix_of(limits, groups)
            sizes = limits.value_lengths().to_numpy(zero_copy_only=False)
            wide[np.arange(groups) >= sizes[:, None]] = np.iinfo(np.int64).min
            asked["limits"] = wide
        sent = rows.sparkSession.sparkContext.broadcast(asked)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            names, queries = asked["vec_id"], asked["parts"]
            best, long = Best(len(names) * groups, k), norms(queries)
            for batch in batches:
                ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
                matrix = matrix_of(batch.column("parts"), queries.shape[1])
                kind = exact_kind(norms(matrix) * long)
                matrix = matrix.astype(kind)
                for own in blocks(len(names), 256):
                    block = {c: v[own] for c, v in asked.items()}
                    scores = block["parts"].astype(kind) @ matrix.T
                    floor = best.floor.reshape(-1, groups)[own]
                    r, c, slot = pick(block, scores, labels, ids, floor)
                    best.add((r + own.start) * groups + slot, ids[c], scores[r, c].astype(np.int64))
            where, slot = np.divmod(best.group, groups)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[where]), pa.array(slot.astype(np.int32)), pa.array(best.ids), pa.array(best.scores)],
                names=["anchor_id", "slot", "vec_id", "score"],
            )

        return rows.mapInArrow(search, columns)

    parts = in_passes(anchors, "vec_id", "parts", searched)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _same_label(block: dict, scores: np.ndarray, labels: np.ndarray, ids: np.ndarray, floor: np.ndarray) -> tuple:
    same = (block["label"][:, None] == labels) & (block["vec_id"][:, None] != ids) & (scores >= floor)
    r, c = np.nonzero(same)
    return r, c, np.zeros(len(r), np.int64)


def _in_slots(block: dict, scores: np.ndarray, labels: np.ndarray, ids: np.ndarray, floor: np.ndarray) -> tuple:
    # Below half of the smallest positive no window reaches; above the highest limit none begins.
    inside = (scores <= block["limits"][:, :1]) & (scores >= block["low"][:, None])
    r, c = np.nonzero(inside & (block["label"][:, None] != labels))
    return r, c, slots_of(r, scores[r, c], block["limits"])


def hard_negatives(
    vectors: DataFrame, modulus: int = 50, positives: int = 5, per_positive: int = 3, scale: int = 256,
    noisy: int = 7, labels: int = 10,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose ``vec_id`` ``modulus`` divides; their positives are the ``positives``
    highest-scoring other rows of the same label, their negatives the ``per_positive`` highest-scoring
    rows of another label from half of the positive's score up to 95 % of it; ties
    go to the smaller id.  Scores are inner products of floor(scale * x).  Where
    ``noisy`` divides the id, the label is the next one modulo ``labels``.
    Rows with a null id, label or vector, or with a null or non-finite component, take
    no part.  Components beyond 2**24 after scaling count as that; of vectors of
    different lengths the common components count.  Of several rows with an anchor's
    id the one with the smallest label and vector asks, and none of them is its
    positive; they can be its negatives, and other repeated rows are listed each.
    An empty table gives no rows.  Other columns are ignored.
    """
    rows = stage(labelled_parts(vectors, scale, noisy, labels), "mining-parts")
    anchors = rows.filter(F.col("vec_id") % modulus == 0).groupBy("vec_id").agg(F.min(F.struct("label", "parts")).alias("m"))
    anchors = stage(anchors.select("vec_id", "m.label", "m.parts"), "mining-anchors")
    near = stage(_scored(rows, anchors, 1, positives, _same_label), "mining-positives")
    # A list of at most ``positives`` an anchor, highest score first.
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id")))
    listed = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(listed.alias("positives"))
    # 100 n <= 95 s at most for n = floor(19 s / 20); 50 s <= 100 n from n = ceil(s / 2) on.
    limits = F.expr("transform(positives, p -> (-19 * p.down - pmod(-19 * p.down, 20)) div 20)")
    low = F.expr("(pmod(positives[size(positives) - 1].down, 2) - positives[size(positives) - 1].down) div 2")
    asking = stage(anchors.join(listed, "vec_id").withColumn("limits", limits).withColumn("low", low), "mining-windows")
    held = _scored(rows, asking.drop("positives"), positives, per_positive, _in_slots)
    slots = held.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), F.col("vec_id").alias("id")))).alias("slots")
    )
    windows = asking.select("vec_id", "positives").join(slots, "vec_id")
    columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for anchor, near, held in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "positives", "slots"))):
                by_slot: list[list[tuple[int, int]]] = [[] for _ in range(positives)]
                for entry in held:
                    by_slot[entry["slot"]].append((entry["down"], entry["id"]))
                merged = merged_slots(by_slot, per_positive)
                for k, p in enumerate(near):
                    score = -p["down"]
                    inside = [(d, i) for d, i in merged[k] if score <= -2 * d]
                    out += [(anchor, p["vec_id"], n + 1, i, score, -d) for n, (d, i) in enumerate(inside)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            found = list(zip(*out)) or [()] * len(kinds)
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds)], names=names)

    return windows.mapInArrow(answered, columns)
