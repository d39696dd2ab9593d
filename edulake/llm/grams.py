"""Counts of byte n-grams over whole texts: summed up inside every task, then by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edulake.llm.textops import Slice, released, slices

#: Stands before a text, and after it where the end counts; no UTF-8 text holds this byte.
EDGE = 0xFF
#: Distinct n-grams that a task sums up before it sends them on.
HELD = 1 << 20


def gram_keys(part: Slice, data: np.ndarray, order: int, end: bool) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every row (and its end) the last ``order`` bytes as one number, and how many a row has.

    ``order`` is at most 8. The texts of a slice are laid out with edges between them.
    """
    sizes = np.diff(part.offsets)
    rows = np.arange(part.rows)
    layout = np.full(len(data) + part.rows * (order - 1 + end), EDGE, dtype=np.uint8)
    shift = (rows + 1) * (order - 1) + rows * int(end)
    layout[np.arange(len(data)) + np.repeat(shift, sizes)] = data
    if len(layout) < order:
        return np.zeros(0, dtype=np.uint64), sizes + int(end)
    keys = np.zeros(len(layout) - order + 1, dtype=np.uint64)
    for place in range(order):
        keys <<= np.uint64(8)
        keys |= layout[place : len(layout) - order + 1 + place]
    counts = sizes + int(end)
    # Keys that end on an edge before a text belong to no text.
    real = np.repeat(np.tile([False, True], part.rows), np.stack((np.full(part.rows, order - 1), counts), 1).ravel())
    return keys[real[order - 1 :]], counts


class Tally:
    """Sums of counts by key that stay bounded: full tallies are handed on."""

    def __init__(self, held: int = HELD):
        self.held, self.size = held, 0
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """Add keys; gives the sums, and forgets them, when they are more than are held."""
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size < 2 * self.held:
            return None
        keys, counts = self.take()
        if len(keys) >= self.held:
            return keys, counts
        self.keys, self.counts, self.size = [keys], [counts], len(keys)
        return None

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        self.keys, self.counts, self.size = [], [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
        return keys[firsts], np.add.reduceat(counts, firsts) if len(firsts) else counts


def counted_batch(found: tuple[np.ndarray, np.ndarray], kind: int | None = None) -> pa.RecordBatch:
    keys, counts = found
    arrays, names = [pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "n"]
    if kind is not None:
        arrays, names = [pa.array(np.full(len(keys), kind, dtype=np.int32)), *arrays], ["kind", *names]
    return pa.RecordBatch.from_arrays(arrays, names)


class Frequent:
    """What is known of frequent keys, sent to every task."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        hashes = hashes.astype(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are frequent, and the counts (or logs) of those."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), dtype=bool)
        return known, self.counts[at[known]]


def lists_of(keys: np.ndarray, row: np.ndarray, rows: int) -> pa.ListArray:
    """The keys of each row as a list of signed longs."""
    order = np.argsort(row, kind="stable")
    offsets = np.append(0, np.cumsum(np.bincount(row, minlength=rows)))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys[order].view(np.int64)))


def gram_sums(keys: np.ndarray, row: np.ndarray, rows: int, logs: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of the logs of each row's frequent keys, and the other keys with their rows."""
    distinct, place = np.unique(keys, return_inverse=True)
    known, found = logs.find(distinct)
    log = np.zeros(len(distinct))
    log[known] = found
    rare = ~known[place]
    return np.bincount(row, log[place], rows), keys[rare], row[rare]


def _gram_batches(order: int, chosen: Callable[[Slice], np.ndarray] | None):
    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for part in slices(batch, "__text"):
                keys, counts = gram_keys(part, part.data, order, end=False)
                if chosen is not None:
                    keys = keys[np.repeat(chosen(part), counts)]
                full = tally.add(keys)
                if full is not None:
                    yield counted_batch(full)
        yield counted_batch(tally.take())

    return run


def gram_counts(rows: DataFrame, order: int, chosen: Callable[[Slice], np.ndarray] | None = None) -> DataFrame:
    """``key`` and ``n`` for every run of ``order`` bytes of the column ``__text``, which holds no null.

    ``chosen`` tells which rows of a slice count; without it all do.
    """
    found = rows.select("__text").mapInArrow(_gram_batches(order, chosen), "key bigint, n bigint")
    return found.groupBy("key").agg(F.sum("n").alias("n"))
