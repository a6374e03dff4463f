"""N-gram scores from a log-frequency Bloom filter.

The corpus is turned once into blocks: a block holds a few thousand documents as
positions into the sorted distinct words of the block.  From there on work is done
per distinct word or word pair of a block, not per token.

* Word counts are exact.  Every block sends its distinct words' training counts to
  buckets of the number range; a bucket adds them up and replies to the blocks.
* Pair counts are quantised: count c has level 1 + floor(log2 c), and the pair is
  entered into the filter once for each level up to that.  A probe asks for level 1,
  2, ... until one is missing; the count is taken as the middle of the last level.
* The filter is built in slices, one per bucket.  While all slices together stay
  under ``broadcast_bytes``, they are sent to the workers as one broadcast.  Beyond
  that, slices stay in their buckets and the blocks' distinct pairs are sent to
  them, as for words; the scores are the same.

A pair's probability is (min(count, c(u)) + mu * P(w)) / (c(u) + mu) with the word
probability P(w) = (c(w) + 1) / (N + V + 1) below it, so it is smoothed towards
words and never zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ratingloom.llm.rows import as_array, bucket_cuts, crc_remainder
from ratingloom.llm.words import mix, word_arrays
from ratingloom.session import stage

#: Stand for the end of a text and for its start (a context only).
END, START = np.uint64(0xE4D0000000000001), np.uint64(0x57A4000000000001)
BLOCK_WORDS = 1 << 19
BITS_PER_ENTRY = 12
PROBES = 6
#: Enough for every 64-bit count; probing stops at the first miss.
MAX_LEVEL = 64
_BLOCK = (
    "block string, doc_id array<long>, held_out array<boolean>, n_tokens array<int>, "
    "vocabulary binary, positions binary"
)


def pair_numbers(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each pair of words."""
    return mix(mix(left) + right)


# --- the filter -------------------------------------------------------------


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count)."""
    return np.frexp(counts.astype(float))[1]


#: The middle of each level's counts on a log scale; level 0 is count 0.
LEVEL_COUNTS = np.concatenate(([0.0, 1.0], 2.0 ** (np.arange(2, MAX_LEVEL + 1) - 0.5)))


def _places(numbers: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        seed = np.uint64(level * 0x9E3779B97F4A7C15 + probe * 0xC2B2AE3D27D4EB4F & (2**64 - 1))
        return (mix(numbers + seed) >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)


def build_slice(numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter's bits, as bytes, for distinct numbers with their counts."""
    levels = levels_of(counts)
    bits = max(64, int(levels.sum()) * BITS_PER_ENTRY + 63 & ~63)
    filled = np.zeros(bits // 8, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        entered = numbers[levels >= level]
        for probe in range(PROBES):
            at = _places(entered, level, probe, bits)
            np.bitwise_or.at(filled, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return filled


def probe_slice(numbers: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """The level that the filter holds for each number."""
    bits = 8 * len(filled)
    found = np.zeros(len(numbers), np.int8)
    alive = np.arange(len(numbers))
    for level in range(1, MAX_LEVEL + 1):
        for probe in range(PROBES):
            at = _places(numbers[alive], level, probe, bits)
            alive = alive[filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1]
        if not len(alive):
            break
        found[alive] = level
    return found


# --- blocks -----------------------------------------------------------------


def word_blocks(documents: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """The corpus as blocks; ``held_out`` documents take no part in counts."""
    chosen = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        (crc_remainder("doc_id", modulus) == remainder).alias("held_out"),
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        task, made = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[bool] = []
        arrays: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            vocabulary, positions = np.unique(np.concatenate(arrays), return_inverse=True)
            row = {
                "block": f"{task}-{made}", "doc_id": ids, "held_out": held, "n_tokens": [len(a) for a in arrays],
                "vocabulary": vocabulary.tobytes(), "positions": squeeze.compress(positions.astype("<u4").tobytes()),
            }
            return pa.RecordBatch.from_pylist([row], schema=shape)

        for batch in batches:
            words = word_arrays((t.as_py() for t in batch.column("text")), lower=True)
            for doc_id, out, found in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), words):
                ids.append(doc_id)
                held.append(out)
                arrays.append(np.append(found, END))
                size += len(found) + 1
                if size >= BLOCK_WORDS:
                    yield block()
                    ids, held, arrays, size, made = [], [], [], 0, made + 1
        if ids:
            yield block()

    shape = to_arrow_schema(_parse_datatype_string(_BLOCK))
    return chosen.mapInArrow(blocks, _BLOCK)


class _Block:
    """One block's arrays."""

    def __init__(self, row: dict) -> None:
        self.vocabulary = as_array(row["vocabulary"], "<u8")
        self.positions = as_array(zstandard.ZstdDecompressor().decompress(row["positions"]), "<u4").astype(np.int64)
        self.lengths = np.array(row["n_tokens"], np.int64)
        self.held = np.array(row["held_out"], bool)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.training = np.repeat(~self.held, self.lengths)

    def word_counts(self) -> np.ndarray:
        """Training count of each word of the block."""
        return np.bincount(self.positions[self.training], minlength=len(self.vocabulary))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs' numbers in ascending order, each token's pair, and the training counts."""
        n = len(self.vocabulary)
        before = np.empty(len(self.positions), np.int64)
        before[1:] = self.positions[:-1]
        before[self.starts] = n  # the start
        keys, of_token = np.unique(before * n + self.positions, return_inverse=True)
        names = np.append(self.vocabulary, START)
        numbers = pair_numbers(names[keys // n], self.vocabulary[keys % n])
        order = np.argsort(numbers)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        of_token = place[of_token]
        return numbers[order], of_token, np.bincount(of_token[self.training], minlength=len(numbers))


def _sent(blocks: DataFrame, buckets: int, what: str, every: bool) -> DataFrame:
    """``block, bucket, numbers, counts``: a block's distinct words or pairs, cut into buckets.

    Without ``every`` only those with a training count are sent.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                block = _Block(row)
                if what == "word":
                    numbers, counts = block.vocabulary, block.word_counts()
                else:
                    numbers, _, counts = block.pairs()
                if not every:
                    numbers, counts = numbers[counts > 0], counts[counts > 0]
                cuts = bucket_cuts(numbers, buckets)
                counts = counts.astype("<u4")
                yield pd.DataFrame([
                    (row["block"], b, numbers[lo:hi].tobytes(), counts[lo:hi].tobytes())
                    for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo
                ], columns=["block", "bucket", "numbers", "counts"])

    columns = ["block", "held_out", "n_tokens", "vocabulary", "positions"]
    return blocks.select(*columns).mapInPandas(cut, "block string, bucket int, numbers binary, counts binary")


def _totals(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers of a bucket, where each sent number stands among them, and their total counts."""
    sent = np.concatenate([as_array(b, "<u8") for b in group["numbers"]])
    counts = np.concatenate([as_array(b, "<u4") for b in group["counts"]])
    numbers, place = np.unique(sent, return_inverse=True)
    return numbers, place, np.bincount(place, counts, len(numbers)).astype(np.int64)


def _replied(sent: DataFrame, answer: str) -> DataFrame:
    """``block, bucket, values``, and one row per bucket (block null) with its ``total`` and ``distinct``.

    ``answer`` is ``count`` (exact, 64-bit) or ``level`` (from the bucket's filter slice, 8-bit).
    """

    def reply(group: pd.DataFrame) -> pd.DataFrame:
        numbers, place, totals = _totals(group)
        if answer == "count":
            values = totals[place].astype("<i8")
        else:
            known = totals > 0
            values = probe_slice(numbers, build_slice(numbers[known], totals[known]))[place]
        ends = np.cumsum([len(b) // 8 for b in group["numbers"]])
        out = pd.DataFrame({
            "block": group["block"], "bucket": group["bucket"],
            "values": [v.tobytes() for v in np.split(values, ends[:-1])], "total": 0, "distinct": 0,
        })
        summary = [None, group["bucket"].iloc[0], b"", int(totals.sum()), int((totals > 0).sum())]
        return pd.concat([out, pd.DataFrame([summary], columns=out.columns)])

    return sent.groupBy("bucket").applyInPandas(
        reply, "block string, bucket int, values binary, total long, distinct long"
    )


# --- the model --------------------------------------------------------------


def _slices(sent: DataFrame) -> DataFrame:
    """``bucket, filled``: the filter's slice of each bucket."""

    def built(group: pd.DataFrame) -> pd.DataFrame:
        numbers, _, totals = _totals(group)
        return pd.DataFrame({"bucket": group["bucket"].iloc[:1], "filled": [build_slice(numbers, totals).tobytes()]})

    return sent.groupBy("bucket").applyInPandas(built, "bucket int, filled binary")


def score(
    documents: DataFrame,
    modulus: int = 7,
    remainder: int = 2,
    mu: float = 4.0,
    broadcast_bytes: int = 128 << 20,
    buckets: int | None = None,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Documents whose crc32(doc_id) modulo ``modulus`` is ``remainder`` are not learned
    from.  A null or empty text is its end alone; a null id counts as empty text in
    the remainder; rows repeated in full are learned from and scored each; with
    nothing to learn from every count is 0; an empty table gives no rows.  Other
    columns are ignored.
    """
    spark = documents.sparkSession
    blocks = stage(word_blocks(documents, modulus, remainder), "lm-blocks")
    # As the corpus grows so does the number of buckets: one holds about two blocks' worth of numbers.
    parts = buckets or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count() // 2)
    replies = stage(_replied(_sent(blocks, parts, "word", True), "count"), "lm-words")
    totals = replies.filter("block is null").agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")
    ).first()
    tokens, distinct = totals["n"], totals["v"]

    slices = stage(_slices(_sent(blocks, parts, "pair", False)), "lm-filter")
    size = slices.agg(F.coalesce(F.sum(F.length("filled")), F.lit(0)).alias("size")).first()["size"]
    words = replies.filter("block is not null").select("block", "bucket", F.lit("word").alias("what"), "values")
    shared = None
    if size <= broadcast_bytes:
        # Bounded: checked just now.
        shared = spark.sparkContext.broadcast({r["bucket"]: bytes(r["filled"]) for r in slices.toLocalIterator()})
    else:
        levels = _replied(_sent(blocks, parts, "pair", True), "level")
        words = words.unionByName(
            levels.filter("block is not null").select("block", "bucket", F.lit("pair").alias("what"), "values")
        )

    def scored(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.to_dict("records")[0]
        block = _Block(row)
        right = right.sort_values("bucket")
        counts = np.concatenate([as_array(b, "<i8") for b in right["values"][right["what"] == "word"]])
        unigram = np.log10((counts + 1) / (tokens + distinct + 1))
        base = np.add.reduceat(unigram[block.positions], block.starts)
        known = np.add.reduceat((counts > 0)[block.positions].astype(np.int64), block.starts)
        numbers, of_token, _ = block.pairs()
        if shared is not None:
            cuts = bucket_cuts(numbers, parts)
            level = np.zeros(len(numbers), np.int8)
            for b, filled in shared.value.items():
                level[cuts[b] : cuts[b + 1]] = probe_slice(numbers[cuts[b] : cuts[b + 1]], as_array(filled, np.uint8))
        else:
            level = np.concatenate([as_array(b, np.int8) for b in right["values"][right["what"] == "pair"]])
        context = np.empty(len(block.positions))
        context[1:] = counts[block.positions[:-1]]
        # The start comes as often as the end.
        at_end = block.positions == np.searchsorted(block.vocabulary, END)
        context[block.starts] = counts[block.positions[at_end][0]]
        together = np.minimum(LEVEL_COUNTS[level][of_token], context)
        probability = (together + mu * 10 ** unigram[block.positions]) / (context + mu)
        total = np.add.reduceat(np.log10(probability), block.starts)
        return pd.DataFrame({
            "doc_id": pd.array(row["doc_id"], dtype="Int64"), "held_out": block.held, "n_tokens": block.lengths,
            "n_known": known, "train_tokens": tokens, "base_score": base, "score": total,
        })

    return blocks.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(
        scored,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
