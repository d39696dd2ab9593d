"""Packing of documents into token windows by best-fit decreasing.

Every task tokenises its rows and packs them in one pass, so no token crosses the network. A document longer than a
window is first cut into full windows, each a sequence of its own. What remains is gathered in groups, and every group
is placed in decreasing length into the tightest open window, which a segment tree over the remaining capacity finds.
Windows that are still open serve the groups that follow. A task that is run again gives the same pieces.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edulake.llm.textops import IS_SPACE, Slice, released, slices, two_hashes, whole_text

WINDOW = 1024
END_ID = 0
#: Pieces, and bytes of their ids, that a task gathers before it places them.
GROUP_PIECES = 1 << 15
GROUP_BYTES = 1 << 25
#: Bytes of a generation of the segments whose ids a worker remembers.
REMEMBERED_BYTES = 1 << 24


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree over the capacities that are present."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.stacks[capacity].append(sequence)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out a window of the least capacity that is no less than ``length``: its capacity and sequence."""
        count = self.count
        node = length + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return capacity, self.stacks[capacity].pop()


def added_tokens(path: str) -> dict[str, int]:
    """The tokens that a tokeniser's JSON file adds to its vocabulary, which are found in texts before all else."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file).get("added_tokens") or []
    for token in found:
        # Segments end at white space, and a token that takes its surroundings along would change them.
        flags = any(token.get(flag) for flag in ("lstrip", "rstrip", "single_word"))
        if flags or not token["content"] or any(c.isspace() for c in token["content"]):
            raise ValueError(f"the added token {token['content']!r} reaches beyond a segment")
    return {token["content"]: token["id"] for token in found}


class _Known:
    """Ids of segments by hash: ``keys`` sorted, each with a second hash, and where its ids begin and end in ``ids``."""

    def __init__(self, keys, checks, begins, sizes, ids):
        order = np.argsort(keys, kind="stable")
        self.keys, self.checks, self.begins, self.sizes = keys[order], checks[order], begins[order], sizes[order]
        self.ids = ids

    @classmethod
    def none(cls) -> _Known:
        empty = np.zeros(0, dtype=np.int64)
        return cls(empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty.astype(np.uint32))

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (self.checks[at] == checks), at, -1)

    def with_others(self, other: _Known) -> _Known:
        names = ("keys", "checks", "begins", "sizes")
        own, more = ([getattr(x, n) for n in names] for x in (self, other))
        more[2] = more[2] + len(self.ids)
        return _Known(*map(np.concatenate, zip(own, more, strict=True)), np.concatenate((self.ids, other.ids)))

    def size(self) -> int:
        return 32 * len(self.keys) + 4 * len(self.ids)


class Segments:
    """Token ids of texts from the ids of their segments.

    A segment begins at white space that follows another character, where every byte-level pre-tokeniser of this
    family also begins a token; so the ids of a text are the ids of its segments in turn. Segments that recur are
    remembered as arrays, under two 64-bit hashes, in generations: a small newest one, which goes into the newer one when
    it is large, and the older one, which the newer one replaces when it is full. What a slice does not find there is
    put together to one text and encoded at once; the bytes of the tokens tell which segment they belong to.
    """

    def __init__(self, path: str, pattern: str, added: str | None = None):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        special = added_tokens(added) if added else {}
        self.special = [token.encode() for token in special]
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.bytes_of = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.bytes_of[rank] = len(token)
        self.newest = self.newer = self.older = _Known.none()

    def _alone(self, segment: bytes) -> np.ndarray:
        """The ids of one segment, added tokens included."""
        return np.array(self.encoding.encode(segment.decode("utf-8", "replace"), allowed_special="all"), dtype=np.uint32)

    def _ids(self, segments: list[bytes], joined: np.ndarray, special: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of segments in any order, and where those of each begin and how many it has.

        ``joined`` tells which segments begin a token of their own in any text.
        """
        if special:
            joined = joined & ~np.array([any(t in s for t in self.special) for s in segments], dtype=bool)
        begins, sizes = np.zeros(len(segments), dtype=np.int64), np.zeros(len(segments), dtype=np.int64)
        found, count = [np.zeros(0, dtype=np.uint32)], 0
        together = np.flatnonzero(joined)
        if len(together):
            own = [segments[k] for k in together.tolist()]
            ends = np.cumsum([len(s) for s in own])
            ids = self.encoding.encode_to_numpy(b"".join(own).decode("utf-8"), disallowed_special=()).astype(np.uint32)
            upto = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
            sizes[together] = np.diff(upto, prepend=0)
            begins[together] = upto - sizes[together]
            found.append(ids)
            count = len(ids)
        for k in np.flatnonzero(~joined).tolist():
            ids = self._alone(segments[k])
            begins[k], sizes[k] = count, len(ids)
            found.append(ids)
            count += len(ids)
        return np.concatenate(found), begins, sizes

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and how many each of its texts has."""
        data = part.data
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(part.rows, dtype=np.int64)
        starts, ends, joined = self._segments(part)
        keys, checks = two_hashes(data, starts, ends)
        keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        checks = checks[first]
        sizes = np.zeros(len(keys), dtype=np.int64)
        begins = np.zeros(len(keys), dtype=np.int64)
        flat, base = [], 0
        left = np.arange(len(keys))
        for known in (self.newest, self.newer, self.older):
            at = known.find(keys[left], checks[left])
            hit = left[at >= 0]
            sizes[hit] = known.sizes[at[at >= 0]]
            begins[hit] = known.begins[at[at >= 0]] + base
            flat.append(known.ids)
            base += len(known.ids)
            if known is self.older:
                kept = hit
            left = left[at < 0]
        raw = data.tobytes()
        begin, end = starts[first[left]].tolist(), ends[first[left]].tolist()
        special = any(token in raw for token in self.special)
        new, place, length = self._ids([raw[a:b] for a, b in zip(begin, end)], joined[first[left]], special)  # noqa: B905
        sizes[left], begins[left] = length, place + base
        flat.append(new)
        table = np.concatenate(flat)
        counts = sizes[inverse]
        ends_at = np.cumsum(counts)
        places = np.repeat(begins[inverse] - (ends_at - counts), counts) + np.arange(ends_at[-1])
        per_row = np.bincount(part.row_of(starts), weights=counts, minlength=part.rows).astype(np.int64)
        self._remember(keys, checks, begins, sizes, np.concatenate((left, kept)), table)
        return table[places], per_row

    def _remember(self, keys, checks, begins, sizes, which, table) -> None:
        """Keep segments that are new, or that only the older generation has."""
        length = sizes[which]
        ends = np.cumsum(length)
        if not len(which):
            return
        ids = table[np.repeat(begins[which] - (ends - length), length) + np.arange(ends[-1])]
        new = _Known(keys[which], checks[which], ends - length, length, ids)
        self.newest = self.newest.with_others(new)
        if self.newest.size() > REMEMBERED_BYTES >> 4:
            self.newer, self.newest = self.newer.with_others(self.newest), _Known.none()
            if self.newer.size() > REMEMBERED_BYTES:
                self.older, self.newer = self.newer, _Known.none()

    @staticmethod
    def _segments(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = part.data
        space = IS_SPACE[data]
        solid = (data > 0x20) & (data < 0x7F)
        # The last byte of a longer character; the lead bytes named here begin no white space.
        tail = np.flatnonzero((data >= 0x80) & (data < 0xC0))
        lead = np.zeros(256, dtype=np.int64)
        lead[0xC3:0xE0] = 1
        lead[[0xE0, *range(0xE4, 0xF0)]] = 2
        lead[0xF0:0xF5] = 3
        for back in (1, 2, 3):
            own = tail[tail >= back]
            solid[own[lead[data[own - back]] == back]] = True
        begin = np.zeros(len(data), dtype=bool)
        begin[1:] = space[1:] & solid[:-1]
        firsts = part.offsets[:-1]
        begin[firsts[firsts < part.offsets[1:]]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        # With white space before it and a solid character at its end, a segment can stand between any others.
        return starts, ends, space[starts] & solid[ends - 1]


_segments: dict[tuple, Segments] = {}


def _segments_of(path: str, pattern: str, added: str | None) -> Segments:
    """The tokeniser of this worker, which serves all its tasks."""
    if (path, pattern, added) not in _segments:
        _segments[path, pattern, added] = Segments(path, pattern, added)
    return _segments[path, pattern, added]


class _Pieces:
    """Rows of the result that wait to be sent."""

    def __init__(self):
        self.rows: list[tuple] = []

    def batch(self, names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[] for _ in names]
        kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array(column, type=kind) for column, kind in zip(columns, kinds)]
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, names)


def _pack_batches(path: str, pattern: str, added: str | None, window: int, end_id: int, names: list[str]):
    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, open_windows = _segments_of(path, pattern, added), OpenWindows(window)
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        held = 0
        out = _Pieces()
        id_type = pa.int64()

        def place() -> int:
            nonlocal sequence
            waiting.sort(key=lambda piece: -len(piece[2]))
            for id, start, ids, total in waiting:
                length = len(ids) >> 2
                found = open_windows.tightest(length)
                if found is None:
                    capacity, own = window, sequence
                    sequence += 1
                else:
                    capacity, own = found
                if capacity > length:
                    open_windows.add(capacity - length, own)
                out.rows.append((id, start, length, ids, total, own, window - capacity))
            waiting.clear()
            return 0

        for batch in batches:
            id_type = batch.column("__id").type
            for part in slices(batch, "__text"):
                ids, counts = encoder.encode(part)
                begin = 0
                for id, count in zip(part.column("__id").to_pylist(), counts.tolist()):
                    own = np.append(ids[begin : begin + count], np.uint32(end_id)).astype("<u4").tobytes()
                    begin += count
                    total = count + 1
                    for start in range(0, total - total % window, window):
                        piece = own[4 * start : 4 * (start + window)]
                        out.rows.append((id, start, window, piece, total, sequence, 0))
                        sequence += 1
                    if total % window:
                        start = total - total % window
                        waiting.append((id, start, own[4 * start :], total))
                        held += 4 * (total - start)
                if len(waiting) >= GROUP_PIECES or held >= GROUP_BYTES:
                    held = place()
                if len(out.rows) >= 1024:
                    yield out.batch(names, id_type)
        place()
        yield out.batch(names, id_type)

    return run


def pack(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    added: str | None = None,
) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id`` and ``offset``.

    ``ranks`` is the file of a byte-level tokeniser's tokens in the order of their merges, at the same path on every
    machine, and ``pattern`` cuts texts before merging. ``added`` is the tokeniser's JSON file, whose added tokens get
    their own ids where a text holds them; without it they are plain text. A document's ids are those of its text, then ``end_id``; a null text is empty, so it is one piece of one id. ``ids``
    holds little-endian unsigned 32-bit numbers. Pieces fill a sequence without gaps from offset 0 and no sequence
    exceeds ``window``. Ids may be null or repeat; each row is packed. No rows give no pieces.
    """
    names = [id, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kind = docs.select(id).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id).alias("__id"), whole_text(F.col(text)).alias("__text"))
    schema = f"`{id}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return rows.mapInArrow(_pack_batches(ranks, pattern, added, window, end_id, names), schema)
