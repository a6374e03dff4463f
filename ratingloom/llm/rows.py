"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the stored tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def digest(*parts: Column | str | int) -> Column:
    """A seeded order that SQL engines agree on: the MD5 of the parts as text."""
    as_text = [F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws(":", *as_text))


def digest_number(*parts: Column | str | int) -> Column:
    """The first eight hex digits of :func:`digest` as a number."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("long")


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of a column as text, modulo a number; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def buckets_of(numbers: np.ndarray, count: int) -> np.ndarray:
    """The bucket, 0 .. count-1, of each 64-bit number: equal parts of their range."""
    return ((numbers >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def bucket_cuts(sorted_numbers: np.ndarray, count: int) -> np.ndarray:
    """Where each bucket begins in sorted numbers, with the end."""
    return np.searchsorted(buckets_of(sorted_numbers, count), np.arange(count + 1))


#: Rows of numbers and short keys that may be sent to every worker: 64 MB at most.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of a few numbers a row, marked for broadcast if it has at most ``most`` rows.

    A larger one is left to be joined by a shuffle.
    """
    return F.broadcast(df) if df.count() <= most else df


def as_array(blob: bytes, kind: str) -> np.ndarray:
    """A blob's numbers."""
    return np.frombuffer(blob, kind)


def tidied(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``function`` over batches, giving freed memory back to the system at its end: workers outlive their tasks."""

    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        given_back()

    return run


def given_back() -> None:
    """Give this worker's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not the GNU library


def frame(**columns: object) -> pd.DataFrame:
    """A pandas frame from named columns."""
    return pd.DataFrame(columns)


def carried(df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], more: str) -> DataFrame:
    """``df`` with columns that ``function`` computes from frames of ``text``.

    Only the text goes through Python as pandas columns; the other columns are
    carried along as Arrow arrays, so no type or null changes on the way.
    """
    added = _parse_datatype_string(more)
    schema = StructType([*df.schema.fields, *added.fields])
    shape = to_arrow_schema(schema)
    place = df.columns.index("text")
    names = added.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (found,) = function(iter([pd.DataFrame({"text": batch.column(place).to_pandas()})]))
            new = [pa.array(found[n], shape.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=shape)

    return df.mapInArrow(tidied(run), schema)
