"""Flat views of text columns for vectorised work inside Spark tasks.

A batch of texts is one UTF-8 byte buffer with document offsets; words are
byte ranges of that buffer. Every helper is linear in the bytes it is given,
and :func:`text_slices` bounds those bytes, whatever the batch size is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

SLICE_BYTES = 8 << 20


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the system, where its C library can: later stages reuse the worker."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES
                ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text (one row at least)."""
    if not batch.num_rows:
        return
    data, offsets = string_buffer(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start), data[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start]
        start = end
    release()


Judge = Callable[[pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray]


def kept_rows(docs: DataFrame, judge: Callable[[], Judge], text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Whole rows of ``docs`` that a task's ``judge()`` keeps: it gets (rows, bytes, offsets) of a run of texts. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = judge()
        for batch in batches:
            for rows, data, offsets in text_slices(batch, text, limit):
                yield rows.filter(pa.array(keep(rows, data, offsets)))

    return docs.mapInArrow(run, docs.schema)


def byte_table(keep) -> np.ndarray:
    """256 booleans from a predicate on the byte value."""
    return np.fromiter((bool(keep(b)) for b in range(256)), bool, 256)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALNUM = byte_table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LETTER = byte_table(lambda b: b >= 0x80 or 0x61 <= b <= 0x7A)


class Words:
    """Words of a run of documents: maximal runs of kept bytes, never across documents.

    ``codes`` indexes the distinct words; ``starts``/``ends`` are byte places
    in the run; ``first`` has the first word of every document (and the end).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep: np.ndarray):
        inside = keep[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data) + 1, bool)
        before[0] = False
        before[1:] = inside
        now = np.empty(len(data) + 1, bool)
        now[-1] = False
        now[:-1] = inside
        self.starts = np.flatnonzero(now & (~before | edge))
        self.ends = np.flatnonzero(before & (~now | edge))
        self.first = np.searchsorted(self.starts, offsets)
        lengths = self.ends - self.starts
        bounds = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=bounds[1:])
        flat = np.ascontiguousarray(data[inside])
        words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])
        encoded = words.dictionary_encode()
        self.codes = encoded.indices.to_numpy(zero_copy_only=False)
        self.distinct = encoded.dictionary

    def __len__(self) -> int:
        return len(self.starts)

    def buffers(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the distinct words."""
        n = len(self.distinct)
        offsets = np.frombuffer(self.distinct.buffers()[1], np.int64)[self.distinct.offset:self.distinct.offset + n + 1]
        data = self.distinct.buffers()[2]
        return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets

    def hashes(self) -> np.ndarray:
        """64-bit hash of every distinct word."""
        return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.distinct.to_pylist()), np.uint64, len(self.distinct))


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``values[s:s + n]`` for all (s, n)."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def sums_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for all i, in double precision; 0 where empty."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def max_by(values: np.ndarray, bounds: np.ndarray, empty: float = 0.0) -> np.ndarray:
    """Largest of ``values[bounds[i]:bounds[i + 1]]``; ``empty`` where there is none."""
    out = np.full(len(bounds) - 1, empty)
    some = bounds[1:] > bounds[:-1]
    if some.any():
        out[some] = np.maximum.reduceat(values, bounds[:-1][some])
    return out


def whole_buckets(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of complete buckets from rows sorted by ``keys``, whatever the batches' borders."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(k).to_numpy() for k in keys]
        last = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key]))
        begin = int(last[-1]) + 1 if len(last) else 0  # where the batch's last bucket begins
        if held and not begin and [held[-1].column(k)[-1].as_py() for k in keys] == [k[0] for k in key]:
            held.append(batch)
            continue
        if done := [*held, batch.slice(0, begin)] if begin else held:
            yield pa.Table.from_batches(done)
        held = [batch.slice(begin)]
    if held:
        yield pa.Table.from_batches(held)
