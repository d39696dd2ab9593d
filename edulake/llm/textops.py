"""Vectorised work on the bytes of whole texts, one slice of an Arrow batch at a time.

A slice is a run of rows whose texts together hold about ``SLICE_BYTES``; a longer text is a slice of its own. So the
arrays that are derived from a slice stay small whatever the size of an Arrow batch. Texts are never cut.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 19
#: Rows of texts that cross to Python at once.
BATCH_ROWS = 1000

#: White space of the operators' words: ``[\x20\x09-\x0D]``.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Lower case of A-Z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240607)
_BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = 0x9E3779B97F4A7C15
_FACTOR_INVERSE = pow(_FACTOR, -1, 1 << 64)


def whole_text(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let this session send at most so many rows to Python at once.

    Whole texts make the usual batch of ten thousand rows tens of megabytes, several times over in both processes of
    every running task; slices are small anyway.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def released(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """Hand free memory back to the system when a task ends, as its worker waits for others with what it holds."""

    @functools.wraps(run)
    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def inner_text(batch: pa.RecordBatch, name: str, column: str = "row") -> pa.Array:
    """The texts of a field of the rows in ``column``, null as empty."""
    return pc.fill_null(pc.struct_field(batch.column(column), name).cast(pa.string()), "")


class Slice:
    """Rows ``first`` to ``last`` of a batch: ``data`` holds their bytes, ``offsets`` where each text begins and ends."""

    def __init__(self, batch: pa.RecordBatch, first: int, last: int, data: np.ndarray, offsets: np.ndarray):
        self.batch, self.first, self.last = batch, first, last
        self.data, self.offsets = data, offsets
        self.rows = last - first

    def column(self, name: str) -> pa.Array:
        return self.batch.column(name).slice(self.first, self.rows)

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        """The row of each byte position."""
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def text_bytes(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def slices(batch: pa.RecordBatch, column: str | pa.Array = "text", most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a batch into slices by the texts of a column, or by those given. No text may be null."""
    if batch.num_rows == 0:
        return
    texts = (batch.column(column) if isinstance(column, str) else column).cast(pa.large_binary())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        own = offsets[first : last + 1]
        yield Slice(batch, first, last, data[own[0] : own[-1]], own - own[0])
        first = last


class Words:
    """Words of a slice: byte positions ``starts`` and ``ends``, the ``row`` of each, and words per row ``counts``."""

    def __init__(self, part: Slice, data: np.ndarray):
        solid = ~IS_SPACE[data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        begins = part.offsets[:-1]
        begins = begins[begins < len(data)]
        first[begins] |= solid[begins]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        finals = part.offsets[1:] - 1
        finals = finals[finals >= 0]
        last[finals] |= solid[finals]
        self.data = data
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.row = part.row_of(self.starts)
        self.counts = np.bincount(self.row, minlength=part.rows)
        self.firsts = np.concatenate(([0], np.cumsum(self.counts)))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.data, self.starts, self.ends)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return values ^ (values >> np.uint64(33))


_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(kind: str, factor: int, count: int) -> np.ndarray:
    if len(_powers[kind]) < count:
        size = max(count, SLICE_BYTES)
        steps = np.full(size + 1, factor, dtype=np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span of bytes; equal spans have equal hashes wherever they stand."""
    size = len(data)
    with np.errstate(over="ignore"):
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[data] * _power("up", _FACTOR, size + 1)[:size], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * _power("down", _FACTOR_INVERSE, size + 1)[starts])


_CHECK_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def two_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``span_hashes``, and hashes of other values of the bytes: spans that agree in both are equal, but for chance."""
    size = len(data)
    back = _power("down", _FACTOR_INVERSE, size + 1)[starts]
    found = []
    with np.errstate(over="ignore"):
        up = _power("up", _FACTOR, size + 1)[:size]
        for values in (_BYTE_VALUES, _CHECK_VALUES):
            sums = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(values[data] * up, out=sums[1:])
            found.append(mix((sums[ends] - sums[starts]) * back))
    return found[0], found[1]


def sum_by_row(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs that begin at ``firsts`` (one more entry than runs); empty runs give 0."""
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[firsts[1:]] - sums[firsts[:-1]]
