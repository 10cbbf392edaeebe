"""Arrow batches of texts as flat NumPy arrays: bounded slices, words, ragged gathers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Text bytes that a slice holds at most, unless one text alone is longer.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and its Python workers, unless one row alone has more.
BATCH_BYTES = 8 << 20

#: The ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def bounded(df: DataFrame) -> DataFrame:
    """``df`` itself, once its session sends Arrow batches of ``BATCH_BYTES`` at most.

    The default bounds rows alone to a useful size; ten thousand long texts would stand in the memory of the executor and
    of its worker several times over. A lower setting of the session stays.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, "1g")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each with up to ``limit`` bytes in ``column``."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column in UTF-8; nulls are empty."""
    kind = pa.large_binary()
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    whole = texts.cast(kind)
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word: a run of bytes without ASCII white space inside one document."""
    solid = ~BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = solid[1:] != solid[:-1]
    edge[0] = edge[-1] = True
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    held = solid[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[held], ends[held]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def pieces(raw: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The byte strings between consecutive cuts, without copying ``raw``."""
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(raw)])


def spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings raw[start:end] of ordered, disjoint spans."""
    if not len(starts):
        return pa.array([], pa.large_binary())
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[0::2], cuts[1::2] = starts, ends
    return pieces(raw, cuts).take(pa.array(np.arange(0, 2 * len(starts) - 1, 2)))


def word_ids(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Exact integer ids of the words in this slice, and the distinct words in id order."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    coded = spans(raw, starts, ends).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one range after the other."""
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths):
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, np.int64) - before, lengths) + np.arange(int(lengths.sum()))


def binary(raw: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary (or string) column from flat bytes and offsets; the slice must stay under 2 GiB."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(raw))]
    return pa.Array.from_buffers(kind or pa.binary(), len(offsets) - 1, buffers)
