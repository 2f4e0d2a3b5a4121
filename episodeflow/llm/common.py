"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from episodeflow.session import ensure_checkpoint_dir, ship_package

#: Text bytes that one vectorised pass inside a task holds at once (a longer text is one pass).
PASS_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def land(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor re-reads the copy instead of repeating the work. ``files``
    (a number that grows with the rows) keeps a small table from being hundreds of tiny files.
    """
    if files is not None:
        df = df.coalesce(files)
    spark = df.sparkSession
    ship_package(spark)
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(rows: int, each: int) -> int:
    """How many parts of about ``each`` rows."""
    return max(1, -(-rows // each))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets; a null row is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(off, dtype=kind)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def passes(batch: pa.RecordBatch, column: str, size: int = PASS_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch whose texts hold about ``size`` bytes, with bytes and offsets of each slice."""
    data, at = text_bytes(batch.column(batch.schema.names.index(column)))
    row, n = 0, len(at) - 1
    while row < n:
        end = int(np.searchsorted(at, at[row] + size, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield batch.slice(row, end - row), data[at[row]: at[end]], at[row: end + 1] - at[row]
        row = end


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all ranges [start, start + length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def by_row(values: np.ndarray, offsets: np.ndarray, ufunc, empty):
    """``ufunc`` over values of each row; rows without values get ``empty``."""
    n = len(offsets) - 1
    out = np.full(n, empty, dtype=values.dtype)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, offsets[:-1][full])
    return out
