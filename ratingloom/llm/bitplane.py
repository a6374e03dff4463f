"""Token ids written as bit planes and read back.

A file holds the ids of documents with neighbouring ``doc_id``, cut into blocks of
``block_ids`` ids.  A block is transposed into bit planes (or byte planes): plane
k holds bit k of every id.  Each plane is compressed with zstandard, an all-zero
plane is left out, and the block's index says where each plane lies and which
documents' ids it holds.  Blocks are rows of a Parquet table, so Spark's committer
keeps half-written files away and any store that Spark can write to will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ratingloom.llm.tokens import encoder
from ratingloom.session import scratch_path, shuffle_partitions

#: Documents of one file, about, where the tables are large.
FILE_DOCUMENTS = 20_000
BLOCK_SCHEMA = (
    "file int, block long, first long, n_ids int, width int, kind string, planes array<int>, payload binary, "
    "documents array<struct<ordinal:long,doc_id:long,offset:int,length:int,last:boolean>>"
)


def pack_block(ids: np.ndarray, kind: str = "bit", level: int = 3) -> tuple[list[int], bytes]:
    """The compressed size of each plane, and the planes one after the other."""
    squeeze = zstandard.ZstdCompressor(level=level)
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    sizes, parts = [], []
    for byte in range(4):
        column = np.ascontiguousarray(raw[:, byte])
        if kind == "byte":
            planes = [column.tobytes()] if column.any() else [b""]
        else:
            bits = np.unpackbits(column.reshape(-1, 1), axis=1, bitorder="little").T
            planes = [np.packbits(p, bitorder="little").tobytes() if p.any() else b"" for p in bits]
        for plane in planes:
            data = squeeze.compress(plane) if plane else b""
            sizes.append(len(data))
            parts.append(data)
    return sizes, b"".join(parts)


def unpack_block(n: int, kind: str, sizes: list[int], payload: bytes) -> np.ndarray:
    """The block's ids."""
    expand = zstandard.ZstdDecompressor()
    raw = np.zeros((n, 4), np.uint8)
    at = 0
    for k, size in enumerate(sizes):
        if size:
            plane = np.frombuffer(expand.decompress(payload[at : at + size]), np.uint8)
            if kind == "byte":
                raw[:, k] = plane
            else:
                raw[:, k // 8] |= np.unpackbits(plane, count=n, bitorder="little") << (k % 8)
        at += size
    return raw.reshape(-1).view("<u4")


class _Writer:
    """Collects one file's documents and yields full blocks."""

    def __init__(self, file: int, block_ids: int, kind: str) -> None:
        self._file, self._size, self._kind = file, block_ids, kind
        self._ids: list[np.ndarray] = []
        self._held = self._blocks = self._ordinal = 0
        self._documents: list[dict] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[dict]:
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, self._size - self._held)
            self._documents.append({
                "ordinal": self._ordinal, "doc_id": doc_id, "offset": self._held, "length": take,
                "last": at + take == len(ids),
            })
            self._ids.append(ids[at : at + take])
            self._held += take
            at += take
            if self._held == self._size:
                yield self.block()
        self._ordinal += 1

    def block(self) -> dict:
        sizes, payload = pack_block(np.concatenate(self._ids), self._kind)
        row = {
            "file": self._file, "block": self._blocks, "first": self._blocks * self._size, "n_ids": self._held,
            "width": 4, "kind": self._kind, "planes": sizes, "payload": payload, "documents": self._documents,
        }
        self._blocks += 1
        self._ids, self._documents, self._held = [], [], 0
        return row

    @property
    def open(self) -> bool:
        return self._held > 0


def write_ids(
    documents: DataFrame,
    path: str,
    end_id: int = 1,
    block_ids: int = 1 << 14,
    kind: str = "bit",
    files: int | None = None,
    vocabulary: str | None = None,
) -> None:
    """Write ``documents`` (``doc_id, text``) as id blocks, in ascending ``doc_id``.

    ``end_id`` closes every document.  A null or empty text gives the end id alone,
    a null ``doc_id`` comes first, rows with one id go by a hash of their text, and an
    empty table gives an empty set of files.
    """
    spark = documents.sparkSession
    schema = to_arrow_schema(_parse_datatype_string(BLOCK_SCHEMA))
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        writer = _Writer(TaskContext.get().partitionId(), block_ids, kind)
        rows: list[dict] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(coder.encode(text.as_py()) + end, "<u4")
                rows.extend(writer.add(doc_id, ids))
                if len(rows) >= 64:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if writer.open:
            rows.append(writer.block())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    count = files or max(shuffle_partitions(spark), -(-documents.count() // FILE_DOCUMENTS))
    # A hash stands for the text among rows with one id, so that no text is sampled for the ranges.
    keyed = chosen.withColumn("text_hash", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(count, "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "text")
    ordered.select("doc_id", "text").mapInArrow(encoded, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(path)


_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC polynomial, in reflected bits."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = (b >> 1) ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def crc_of_parts(parts: list[tuple[int, int]]) -> int:
    """The CRC of a concatenation, from each part's CRC and length in bytes."""
    total = 0
    for crc, length in parts:
        shift, square, n = 1 << 31, 1 << 23, length  # 1, and x**8
        while n:
            if n & 1:
                shift = _times(square, shift)
            square = _times(square, square)
            n >>= 1
        total = _times(shift, total) ^ crc
    return total


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every block of the files with its ids decoded: ``file, block, first, ids, documents``."""

    def decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            rows["ids"] = [
                unpack_block(n, kind, list(sizes), payload).astype(np.int64)
                for n, kind, sizes, payload in zip(rows["n_ids"], rows["kind"], rows["planes"], rows["payload"])
            ]
            yield rows[["file", "block", "first", "ids", "documents"]]

    shape = "documents array<struct<ordinal:long,doc_id:long,offset:int,length:int,last:boolean>>"
    return spark.read.parquet(path).mapInPandas(decoded, f"file int, block long, first long, ids array<long>, {shape}")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    A document's ids may lie in several blocks: each part's CRC is taken where the
    block is decoded, and the parts are put together afterwards.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_block(row["n_ids"], row["kind"], row["planes"], row["payload"])
                found = [
                    (row["file"], d["ordinal"], d["doc_id"], row["first"] + d["offset"], d["length"],
                     zlib.crc32(ids[d["offset"] : d["offset"] + d["length"]].tobytes()))
                    for d in row["documents"]
                ]
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], names=names
                )

    names = ["file", "ordinal", "doc_id", "at", "length", "crc"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    found = spark.read.parquet(path).mapInArrow(
        parts, "file int, ordinal long, doc_id long, at long, length long, crc long"
    )

    @F.pandas_udf("long")
    def joined(pieces: pd.Series) -> pd.Series:
        return pd.Series([
            crc_of_parts([(p["crc"], 4 * p["length"]) for p in row]) if len(row) > 1 else row[0]["crc"] for row in pieces
        ])

    grouped = found.groupBy("file", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("length").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("at", "length", "crc"))).alias("pieces"),
    )
    # One row per file: files come in ascending doc_id.
    sizes = spark.read.parquet(path).groupBy("file").agg(F.sum("n_ids").alias("held"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return grouped.join(bases, "file").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", joined("pieces").alias("ids_crc32")
    )


def round_trip(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write ``documents`` as bit planes under the shared folder, and read their digests back."""
    spark = documents.sparkSession
    path = scratch_path(spark, "bitplane")
    write_ids(documents, path, vocabulary=vocabulary)
    return read_digests(spark, path)
