"""Packing documents into fixed windows, lexical neighbours together.

Document frequencies and the mean length are counted over the whole corpus.  Documents
are then ordered by their heaviest BM25 terms, among terms that are frequent enough to
be shared, and the order is cut into shards of bounded size: documents with the
same heavy terms meet, and a group that overfills a shard is parted by its next terms.
Each shard is a BM25 inverted index over token ids with the corpus' statistics.  A seed document opens a window; the shard's unused documents
with the best BM25 scores for the seed's terms follow until the window is full.  The
document that does not fit is cut, and its rest opens the next window, as its
seed.  What is left at a shard's end is cut into windows of power-of-two lengths,
which need no padding.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ratingloom.llm.rows import given_back, tidied
from ratingloom.llm.tokens import encoder, forget
from ratingloom.operators.index import dense_index
from ratingloom.session import stage

#: Terms of a document that say where it is dealt.
HEAVY_TERMS = 6
#: Share of a shard's documents from which on a term's weights are kept for all of them.
OFTEN = 0.25
_TOKENS = "row long, doc_id long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long"


@dataclass
class Corpus:
    """Number of documents, their mean length, and the documents that hold each term id."""

    documents: int
    mean: float
    held: np.ndarray

    def idf(self, terms: np.ndarray) -> np.ndarray:
        held = self.held[terms]
        return np.log1p((self.documents - held + 0.5) / (held + 0.5))

    @cached_property
    def every_idf(self) -> np.ndarray:
        """The idf of every term id."""
        return self.idf(np.arange(len(self.held)))


def heavy_terms(ids: np.ndarray, corpus: Corpus, least: int, k1: float = 1.2, b: float = 0.75) -> list[int]:
    """A document's terms of most BM25 weight, heaviest first, of those in at least ``least`` documents."""
    terms, counts = _distinct(np.sort(ids))
    shared = corpus.held[terms] >= least
    terms, counts = terms[shared], counts[shared]
    norm = k1 * (1 - b + b * len(ids) / max(corpus.mean, 1))
    weight = corpus.every_idf[terms] * counts * (k1 + 1) / (counts + norm)
    if len(weight) > HEAVY_TERMS:
        # Only what reaches the last place is sorted.
        some = np.flatnonzero(weight >= np.partition(weight, -HEAVY_TERMS)[-HEAVY_TERMS])
        terms, weight = terms[some], weight[some]
    return terms[np.argsort(-weight, kind="stable")[:HEAVY_TERMS]].tolist()


def _distinct(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and how often each stands there."""
    edge = np.ones(len(ordered) + 1, bool)
    np.not_equal(ordered[1:], ordered[:-1], out=edge[1 : len(ordered)])
    at = np.flatnonzero(edge)
    return ordered[at[:-1]], at[1:] - at[:-1]


class Index:
    """BM25 over a shard's documents, each an array of token ids; without ``corpus`` the shard is the corpus."""

    def __init__(self, documents: list[np.ndarray], k1: float = 1.2, b: float = 0.75, corpus: Corpus | None = None) -> None:
        n = len(documents)
        lengths = np.array([len(d) for d in documents], float)
        owners = np.repeat(np.arange(n), lengths.astype(int))
        keys = np.concatenate(documents).astype(np.int64) * n + owners if n else np.zeros(0, np.int64)
        keys.sort()
        pairs, counts = _distinct(keys)
        self._owner = pairs % max(n, 1)
        self._terms, held = _distinct(pairs // max(n, 1))
        self._from = np.append(0, np.cumsum(held))
        idf = corpus.idf(self._terms) if corpus else np.log1p((n - held + 0.5) / (held + 0.5))
        mean = corpus.mean if corpus else lengths.mean() if n else 0
        norm = k1 * (1 - b + b * lengths / max(mean, 1))
        self._weight = np.repeat(idf, held) * counts * (k1 + 1) / (counts + norm[self._owner])
        # Short numbers have a faster stable sort.
        order = np.argsort(self._owner.astype(np.uint16) if n <= 1 << 16 else self._owner, kind="stable")
        self._term_of = np.repeat(np.arange(len(self._terms)), held)[order]
        self._term_from = np.searchsorted(self._owner[order], np.arange(n + 1))
        self._n = n
        # Terms that many documents hold have a row of weights; together at most 1 / OFTEN cells for each of theirs.
        often = held >= max(OFTEN * n, 1)
        self._row = np.where(often, np.cumsum(often) - 1, -1)
        self._rows = np.zeros((int(often.sum()), n))
        here = np.repeat(often, held)
        self._rows[np.repeat(self._row, held)[here], self._owner[here]] = self._weight[here]

    def scores(self, seed: int) -> np.ndarray:
        """The score of every document for one document's distinct terms."""
        terms = self._term_of[self._term_from[seed] : self._term_from[seed + 1]]
        rows = self._row[terms]
        total = self._rows[rows[rows >= 0]].sum(axis=0)
        terms = terms[rows < 0]
        if not len(terms):
            return total
        runs = [slice(a, b) for a, b in zip(self._from[terms].tolist(), self._from[terms + 1].tolist())]
        owners = np.concatenate([self._owner[r] for r in runs])
        return total + np.bincount(owners, np.concatenate([self._weight[r] for r in runs]), self._n)


def fill(documents: list[np.ndarray], window: int, corpus: Corpus | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """``document, start, length, sequence, offset`` of every piece of one shard."""
    index = Index(documents, corpus=corpus)
    unused = np.ones(len(documents), bool)
    queue: list[tuple[int, int]] = []  # the rest of a cut document
    pieces: list[tuple[int, int, int]] = []
    room, sequence, following = window, 0, 0
    placed: list[tuple[int, int, int, int, int]] = []

    def close() -> None:
        nonlocal room, sequence, pieces
        placed.extend((d, s, n, sequence, o) for d, s, n, o in pieces)
        pieces, room, sequence = [], window, sequence + 1

    def put(document: int, start: int) -> None:
        nonlocal room
        unused[document] = False
        take = min(len(documents[document]) - start, room)
        pieces.append((document, start, take, window - room))
        room -= take
        if start + take < len(documents[document]):
            queue.append((document, start + take))
        if room == 0:
            close()

    while True:
        if queue:
            seed, start = queue.pop()
        else:
            while following < len(documents) and not unused[following]:
                following += 1
            if following == len(documents):
                break
            seed, start = following, 0
        opened = sequence
        put(seed, start)
        if sequence != opened:
            continue
        scores = index.scores(seed)
        rest = np.flatnonzero(unused)
        for neighbour in rest[np.argsort(-scores[rest], kind="stable")].tolist():
            put(neighbour, 0)
            if sequence != opened:
                break
    yield from placed
    # The last window of the shard is not full: powers of two need no padding.
    left, at, size = sum(p[2] for p in pieces), 0, 0
    for document, start, length, _ in pieces:
        while length:
            if at == 0:
                size = 1 << (left.bit_length() - 1)
            take = min(length, size - at)
            yield document, start, take, sequence, at
            at, left, start, length = at + take, left - take, start + take, length - take
            if at == size:
                at, sequence = 0, sequence + 1


def _tokens(documents: DataFrame, end_id: int, vocabulary: str | None) -> DataFrame:
    """``row, doc_id, ids`` of every document, its ids compressed."""
    chosen = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = to_arrow_schema(_parse_datatype_string(_TOKENS))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, squeeze = encoder(vocabulary), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = [squeeze.compress(coder.encode(t.as_py()) + end) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], schema=kinds)

    return chosen.mapInArrow(tidied(encoded), _TOKENS)


def _unpacked(blobs: pa.Array) -> Iterator[np.ndarray]:
    loose = zstandard.ZstdDecompressor()
    return (np.frombuffer(loose.decompress(b.as_py()), "<u4") for b in blobs)


def count_terms(tokens: DataFrame) -> Corpus:
    """The corpus' statistics; what reaches the driver is bounded by the vocabulary."""
    columns = "term long, held long, total long"
    kinds = to_arrow_schema(_parse_datatype_string(columns))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, total = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for ids in _unpacked(batch.column("ids")):
                terms, _ = _distinct(np.sort(ids))
                if terms[-1] >= len(held):
                    held = np.concatenate((held, np.zeros(int(terms[-1]) + 1 - len(held), np.int64)))
                held[terms] += 1
                rows, total = rows + 1, total + len(ids)
        terms = np.flatnonzero(held)
        # The row of term -1 counts documents and their lengths.
        found = [np.append(terms, -1), np.append(held[terms], rows), np.append(np.zeros_like(terms), total)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], schema=kinds)

    found = tokens.select("ids").mapInArrow(tidied(counted), columns).groupBy("term").agg(F.sum("held").alias("held"), F.sum("total").alias("total"))
    found = {r["term"]: r for r in found.toLocalIterator()}
    whole = found.pop(-1, {"held": 0, "total": 0})
    held = np.zeros(max(found, default=-1) + 1, np.int64)
    for term, r in found.items():
        held[term] = r["held"]
    return Corpus(whole["held"], whole["total"] / max(1, whole["held"]), held)


def _dealt(tokens: DataFrame, corpus: Corpus, shards: int, shard_documents: int) -> DataFrame:
    """``row, shard``: consecutive documents in the order of their heavy terms share a shard."""
    # Rarer terms bring together too few to fill a shard; they still count in the scores.
    least = max(2, shard_documents // 8)
    columns = "row long, doc_id long, heavy array<int>, same long"
    kinds = to_arrow_schema(_parse_datatype_string(columns))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = list(_unpacked(batch.column("ids")))
            heavy = pa.array([heavy_terms(ids, corpus, least) for ids in every], kinds.field("heavy").type)
            same = pa.array([xxhash.xxh64_intdigest(ids.tobytes()) - 2**63 for ids in every], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), heavy, same], schema=kinds)

    # Written, as the sort into ranges would compute them twice.
    keys = stage(tokens.select("row", "doc_id", "ids").mapInArrow(tidied(keyed), columns), "pack-keys")
    # Equal rows may stand in any order.
    ranked = dense_index(keys, ["heavy", "doc_id", "same", "row"], "rank")
    return ranked.select("row", F.floor(F.col("rank") * shards / corpus.documents).cast("long").alias("shard"))


def pack(
    documents: DataFrame,
    window: int = 4096,
    end_id: int = 2,
    shard_documents: int = 1024,
    vocabulary: str | None = None,
) -> DataFrame:
    """One row per piece: where it lies in its document and in which window.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded``;
    ``padded`` is the window's length with padding.  A null or empty text is the
    end id alone; rows with one ``doc_id`` are packed one by one; a null id stays
    null; an empty table gives no rows.  Other columns are ignored.  Neighbours are
    looked for in a seed's own shard.
    """
    tokens = stage(_tokens(documents, end_id, vocabulary), "pack-tokens")
    corpus = count_terms(tokens)
    shards = max(1, -(-corpus.documents // shard_documents))
    if shards == 1:
        dealt = tokens.withColumn("shard", F.lit(0).cast("long"))
    else:
        dealt = tokens.join(_dealt(tokens, corpus, shards, shard_documents), "row")
    kinds = to_arrow_schema(_parse_datatype_string(PIECES))

    def packed(group: pa.Table) -> pa.Table:
        forget()
        shard = group.column("shard")[0].as_py()
        rows = zip(group.column("doc_id").to_pylist(), _unpacked(group.column("ids")))
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].tobytes()))
        names = [name for name, _ in rows]
        ids = [i for _, i in rows]
        found = list(fill(ids, window, corpus))
        lengths = Counter()
        for _, _, n, sequence, _ in found:
            lengths[sequence] += n
        columns = zip(*[
            (names[d], start, n, zlib.crc32(ids[d][start : start + n].tobytes()), len(ids[d]), (shard << 32) + sequence,
             offset, lengths[sequence] if lengths[sequence].bit_count() == 1 else window)
            for d, start, n, sequence, offset in found
        ])
        given_back()
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=kinds)

    return dealt.select("shard", "doc_id", "ids").groupBy("shard").applyInArrow(packed, PIECES)
