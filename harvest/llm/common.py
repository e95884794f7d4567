"""Helpers of the operators that read whole texts in Arrow batches."""

from __future__ import annotations

import ctypes
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 4 << 20       # text handled at once by one task; a longer single text is one slice
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold no more than a slice, unless the session sets its own bound.

    By default a batch may hold 64 MB, several times over on either side of the pipe to Python.
    """
    if spark.conf.get(_BATCH, None) in (None, "64MB", "67108864", "67108864b"):
        spark.conf.set(_BATCH, f"{SLICE_BYTES}b")


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in order, in slices of at most ``limit`` bytes of text (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, before = 0, 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start, before = end, int(ends[end - 1])


def released() -> None:
    """Give memory that is free, in Arrow's pool and the C library, back to the system; workers outlive a stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # absent outside the GNU library
    if trim is not None:
        trim(0)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of ``texts`` one after another, and where each text starts (one more entry: the end)."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Arrow binary values that lie one after another in ``data``; ``starts`` ends with the length."""
    return pa.Array.from_buffers(
        pa.binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def byte_set(characters: bytes) -> np.ndarray:
    """Table of 256 flags, set for ``characters``."""
    table = np.zeros(256, bool)
    table[np.frombuffer(characters, np.uint8)] = True
    return table


SPACE = byte_set(b"\x20\x09\x0a\x0b\x0c\x0d")


class Words:
    """Words of some texts, by default ``[^\\x20\\x09-\\x0D]+``, else runs of the bytes flagged in ``inside``: ``ids`` equal for equal words, ``first[i]`` is text i's first.

    ``lower`` folds A-Z. Texts without words have none; nulls count as empty texts.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, inside: np.ndarray | None = None):
        self.data, self.offsets = text_bytes(texts)
        data = self.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        inside = ~SPACE[data] if inside is None else inside[data]
        start = inside.copy()
        if len(data):
            start[1:] &= ~inside[:-1]
            bounds = self.offsets[:-1]
            bounds = bounds[bounds < len(data)]
            start[bounds] |= inside[bounds]
        self.inside, at = inside, np.flatnonzero(start)
        kept = np.cumsum(inside)
        where = np.append(kept[at] - 1, kept[-1] if len(kept) else 0) if len(at) else np.zeros(1, np.int64)
        self.values = strings(data[inside], where).dictionary_encode() if len(at) else None
        self.ids = self.values.indices.to_numpy().astype(np.int64) if len(at) else np.zeros(0, np.int64)
        self.at = at
        self.first = np.searchsorted(at, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def distinct(self) -> list[bytes]:
        return self.values.dictionary.to_pylist() if self.values is not None else []


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(values: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values, one to one (the public splitmix64 finish)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


def free_name(columns: Iterable[str]) -> str:
    """A column name that is not among ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    return next(n for n in map("_own{}".format, itertools.count()) if n not in taken)
