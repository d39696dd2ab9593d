"""SimHash near-duplicates by an inverted index over the byte positions of the fingerprints.

Two 64-bit fingerprints that differ in at most four bits agree in at least four of their eight bytes. The index posts
every distinct fingerprint under triples of (position, byte). The triples form a Turan system: any four positions hold
one of them whole, so no pair is missed. Pairs that meet under a key are tallied for the byte positions they share,
those below the guaranteed four are dropped, and the rest are verified bit by bit.

Equal fingerprints are one entry, so copies cost nothing. A key with many fingerprints is cut into blocks, and pairs
of blocks are dealt out as cells of bounded size; in each cell a search yields a spanning forest of its links and never
all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edulake.llm.graph import components
from edulake.llm.textops import inner_text, mix, released, slices, whole_text
from edulake.session import release, settle, shuffles_freed

#: Words of a shingle, seed of its hash, and bits in which linked fingerprints may differ.
SHINGLE_WORDS = 4
HASH_SEED = 42
MAX_BITS = 4
#: Fingerprints of one key that are compared in one block.
BLOCK = 1024

_LANES = np.uint64(0x0101010101010101)


def position_triples(positions: int = 8) -> list[tuple[int, int, int]]:
    """Triples of byte positions such that any four positions contain one of them (Turan's construction)."""
    part = [p % 3 for p in range(positions)]
    found = []
    for triple in combinations(range(positions), 3):
        own = sorted(part[p] for p in triple)
        if own[0] == own[2] or tuple(own) in ((0, 0, 1), (1, 1, 2), (0, 2, 2)):
            found.append(triple)
    return found


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of every run of ``words`` words of the lower-cased text; of the whole sequence when it has fewer."""
    found = text.lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(joined, HASH_SEED)]
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())
    return [digest(joined[s:e], HASH_SEED) for s, e in pairs]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes, the bits that are set in over half of them; an empty run gives 0."""
    result = np.zeros(len(counts), dtype=np.uint64)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return result
    sizes = counts[filled]
    ends = np.cumsum(sizes)
    # Byte lanes add up to 255 hashes at once, so every run is cut into pieces of that length.
    pieces = -(-sizes // 255)
    piece_ends = np.cumsum(pieces)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(piece_ends[-1]) - np.repeat(piece_ends - pieces, pieces)
    begins = (ends - sizes)[owner] + nth * 255
    bits = np.zeros(len(sizes), dtype=np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, begins)
        tallies = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), piece_ends - pieces, axis=0)
        over = (2 * tallies > sizes[:, None]).astype(np.uint64)
        for byte in range(8):
            bits |= over[:, byte] << np.uint64(8 * byte + bit)
    result[filled] = bits
    return result


def _fingerprint_batches(words: int, field: str | None):
    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = []
            for part in slices(batch, "__text" if field is None else inner_text(batch, field)):
                lists = [shingle_hashes(part.text_bytes(row), words) for row in range(part.rows)]
                counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
                flat = np.fromiter((h for own in lists for h in own), dtype=np.uint64, count=int(counts.sum()))
                found.append(majority_bits(flat, counts).view(np.int64))
            prints = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
            kept = [n for n in batch.schema.names if n != "__text"]
            rows = np.arange(number, number + len(prints))
            number += len(prints)
            arrays = [*(batch.column(n) for n in kept), pa.array(rows), pa.array(prints)]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "__row", "__print"])

    return run


def fingerprints(rows: DataFrame, text: str | None = None, field: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """Add ``__row``, a number for the row, and ``__print``, the fingerprint as a signed long.

    The column ``text`` is replaced by them; without one the text is the ``field`` of the column ``row``, which stays.
    Null and wordless texts have the fingerprint 0.
    """
    kept = [c for c in rows.columns if c != text]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    whole = [whole_text(F.col(text)).alias("__text")] if text else []
    run = _fingerprint_batches(words, None if text else field)
    return rows.select(*kept, *whole).mapInArrow(run, f"{schema}, __row bigint, __print bigint")


def _forest(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between fingerprints: count filter over shared bytes first, then the bits."""
    shared = 8 - bits
    rest = prints
    links: list[tuple[int, int]] = []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            differing = rest ^ node
            near = np.flatnonzero((differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= shared)
            near = near[np.bitwise_count(differing[near]) <= bits]
            if len(near):
                found = rest[near]
                links += [(int(node), int(x)) for x in found]
                queue += list(found)
                rest = np.delete(rest, near)
    return links


def _link_batches(bits: int):
    def emit(prints: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        sizes = ends - starts
        pairs = starts[sizes == 2]
        differing = prints[pairs] ^ prints[pairs + 1]
        tally = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        pairs = pairs[(tally >= 8 - bits) & (np.bitwise_count(differing) <= bits)]
        links = [x for s, e in zip(starts[sizes > 2], ends[sizes > 2]) for x in _forest(prints[s:e], bits)]
        extra = np.array(links, dtype=np.uint64).reshape(-1, 2)
        a = np.concatenate((prints[pairs], extra[:, 0])).view(np.int64)
        b = np.concatenate((prints[pairs + 1], extra[:, 1])).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, prints = np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            own = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "i", "j")], axis=1)
            cells = np.concatenate((cells, own))
            values = batch.column("print").to_numpy(zero_copy_only=False).astype(np.int64)
            prints = np.concatenate((prints, values.view(np.uint64)))
            changes = np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1
            if len(changes):  # the last cell may go on in the next batch
                bounds = np.concatenate(([0], changes))
                yield emit(prints, bounds[:-1], bounds[1:])
                cells, prints = cells[changes[-1] :], prints[changes[-1] :]
        if len(prints):
            yield emit(prints, np.array([0]), np.array([len(prints)]))

    return run


def _byte(position: int) -> Column:
    return F.shiftrightunsigned(F.col("print"), 8 * position).bitwiseAND(F.lit(255))


def links(prints: DataFrame, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links ``a``, ``b`` that join all distinct fingerprints (column ``print``) at ``bits`` or fewer differing bits.

    Any two fingerprints that differ in at most four bits are joined, directly or through others.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the index of byte triples holds for at most four differing bits")
    keys = [
        F.lit(n << 24)
        .bitwiseOR(F.shiftleft(_byte(x), 16))
        .bitwiseOR(F.shiftleft(_byte(y), 8))
        .bitwiseOR(_byte(z))
        .alias(f"k{n}")
        for n, (x, y, z) in enumerate(position_triples())
    ]
    index = prints.select("print", F.explode(F.array(*[k.cast("bigint") for k in keys])).alias("key"))
    crowded = settle(index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    met = index.join(crowded, "key").select(
        "key", "print", blocks.alias("blocks"), F.pmod(F.xxhash64("print"), blocks).cast("int").alias("own")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = met.select("key", "print", "own", other).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "print"
    )
    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "print")
    return dealt.mapInArrow(_link_batches(bits), "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, bits: int = MAX_BITS
) -> DataFrame:
    """Per row: the id, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest id reachable.

    Rows are linked when their fingerprints differ in at most ``bits`` bits; a component joins all that are linked
    through others. Null texts count as empty: the fingerprint is zero, linked like any other. Repeated rows each get
    their row. A null id never is the smallest; a component of null ids alone has a null component. No rows give none.
    """
    rows = settle(fingerprints(docs.select(F.col(id).alias("__id"), F.col(text).alias("__whole")), "__whole", words=words))
    reached = _reached(rows, F.min("__id").alias("least"), F.least("first", "least"), bits)
    return rows.join(settle(reached), "__print").select(
        F.col("__id").alias(id),
        F.lower(F.lpad(F.hex("__print"), 16, "0")).alias("fingerprint"),
        F.col("least").alias("component_id"),
    )


def _reached(
    rows: DataFrame, smallest: Column, lesser: Column, bits: int, linked: DataFrame | None = None
) -> DataFrame:
    """``__print`` of every class of equal fingerprints, and ``least``, the smallest over all it is linked to.

    ``smallest`` aggregates the rows of a class as ``least``; ``lesser`` compares ``first`` and ``least``, if any.
    Classes are linked by ``linked``, or else by their fingerprints.
    """
    classes = settle(rows.groupBy("__print").agg(smallest).withColumnRenamed("least", "first"))
    if linked is None:
        linked = links(classes.select(F.col("__print").alias("print")), bits)
    joined = settle(components(linked).withColumnRenamed("node", "__print"))
    linked = classes.join(joined, "__print")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    found = settle(linked.select("__print", "component").join(least, "component").select("__print", "least"))
    return classes.join(found, "__print", "left").select("__print", lesser.alias("least"))


def keep_one(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, bits: int = MAX_BITS
) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of every component, the row with the smallest id stays.

    Null ids come last, and of rows with one id, also of repeated rows, one stays. Rows are linked as in
    ``near_duplicates``; null, empty and wordless texts are duplicates of each other.
    """
    source = docs.select(F.struct("*").alias("row"), F.col(id).alias("__id"))
    rows = settle(fingerprints(source, field=text, words=words))
    place = F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__row"))
    narrow = rows.select("__id", "__row", "__print")
    # The least of two places; a class without links has its own alone.
    reached = _reached(narrow, F.min(place).alias("least"), F.coalesce("least", "first"), bits)
    kept = reached.select(F.col("least.__row").alias("__row")).distinct()
    gone = settle(narrow.select("__row").join(kept, "__row", "left_anti"))
    return rows.join(gone, "__row", "left_anti").select("row.*")


# -- wide fingerprints, for pairs that are similar but not nearly equal --------------------------------------

#: Words of a shingle and similarity of linked texts, 64-bit lanes of a wide fingerprint, and how often its bytes are
#: dealt out to triples.
SIMILAR_WORDS, SIMILARITY = 5, 0.8
LANES, DEALS = 16, 4
#: Entries of an index key that all others of it are compared with first. The texts of a large group share very many keys,
#: with others of the group at their head, so they are joined without all of their pairs. Entries that are not joined then
#: all meet each other.
HEADS = 2
#: Entries of a key that a task holds at once; keys with more are cut into blocks.
HELD_ENTRIES = 1 << 14

_lanes = np.random.default_rng(64).integers(1, 1 << 63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def triples_of(positions: int, deals: int = DEALS) -> np.ndarray:
    """Triples of byte positions: all positions in random order, cut in threes, several times over."""
    choose = np.random.default_rng(positions)
    return np.concatenate([choose.permutation(positions)[: positions // 3 * 3].reshape(-1, 3) for _ in range(deals)])


def similar_limits(similarity: float, lanes: int = LANES) -> tuple[int, int]:
    """Most differing bits, and least equal bytes, of wide fingerprints of texts with so similar shingles.

    Two texts with Jaccard similarity s have shingle counts at an angle with cosine 2s / (1 + s), and a bit differs with
    the angle's share of a half turn. One deviation more is let through, so most pairs at the very limit are kept.
    """
    bits = 64 * lanes
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    most = bits * share + np.sqrt(bits * share * (1 - share))
    equal = (1 - most / bits) ** 8
    least = bits / 8 * equal - 4 * np.sqrt(bits / 8 * equal * (1 - equal))
    return int(most), max(int(least), 1)


def wide_bits(hashes: np.ndarray, counts: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """A row of ``8 * lanes`` bytes for each run of hashes: the majority bits of as many hashes of every shingle."""
    found = np.empty((len(counts), lanes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for lane in range(lanes):
            found[:, lane] = majority_bits(mix(hashes * _lanes[lane]), counts)
    return found.view(np.uint8).reshape(len(counts), 8 * lanes)


def _wide_batches(words: int, lanes: int, field: str):
    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            found: list[bytes] = []
            for part in slices(batch, inner_text(batch, field)):
                lists = [shingle_hashes(part.text_bytes(row), words) for row in range(part.rows)]
                counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
                flat = np.fromiter((h for own in lists for h in own), dtype=np.uint64, count=int(counts.sum()))
                found += [row.tobytes() for row in wide_bits(flat, counts, lanes)]
            rows = np.arange(number, number + len(found))
            number += len(found)
            arrays = [*batch.columns, pa.array(rows), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "__row", "__wide"])

    return run


def _matrix(column: pa.Array, lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 8 * lanes)


def _index_batches(triples: np.ndarray, lanes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column("wide"), lanes).astype(np.int64)
            key = (own[:, triples[:, 0]] << 16) | (own[:, triples[:, 1]] << 8) | own[:, triples[:, 2]]
            key |= np.arange(len(triples)) << 24
            once = [np.repeat(batch.column(n).to_numpy(), len(triples)) for n in ("print", "group")]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, (key.ravel(), *once))), ["key", "print", "group"])

    return run


def _pair_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of prints that share a key: each with the first ones of the key. Rows come sorted by key.

    This only joins large groups ahead of ``_met_batches``, which leaves no pair of different groups out.
    """
    key, heads = None, []
    for batch in batches:
        a, b = [], []
        for own, print_, group in zip(*[batch.column(n).to_pylist() for n in ("key", "print", "group")]):  # noqa: B905
            if own != key:
                key, heads = own, [(print_, group)]
                continue
            others = [head for head, its in heads if its != group]
            a += others
            b += [print_] * len(others)
            if len(others) == len(heads) < HEADS:
                heads.append((print_, group))
        pairs = np.unique(np.array([a, b], dtype=np.int64).reshape(2, -1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _met_batches(held: int = HELD_ENTRIES):
    """All pairs of prints of different groups that share a key, for keys where they are few, as ``a`` and ``b``.

    Keys with more such pairs than twice their entries, or with more than ``held`` entries, are handed on entry by entry,
    with their ``key`` and the print as ``a``. Rows come sorted by key.
    """

    def met(keys: np.ndarray, prints: np.ndarray, groups: np.ndarray) -> tuple[list[np.ndarray], ...]:
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        two = starts[sizes == 2]
        two = two[groups[two] != groups[two + 1]]
        a, b, crowded = [prints[two]], [prints[two + 1]], []
        more = sizes > 2
        mixed = np.minimum.reduceat(groups, starts) != np.maximum.reduceat(groups, starts)
        for at, size in zip(starts[more & mixed], sizes[more & mixed]):
            own = slice(at, at + size)
            counts = np.unique(groups[own], return_counts=True)[1].astype(np.int64)
            if (size * size - (counts * counts).sum()) // 2 > 2 * size:
                crowded.append(np.arange(at, at + size))
                continue
            x, y = np.triu_indices(size, 1)
            apart = groups[own][x] != groups[own][y]
            a.append(prints[own][x[apart]])
            b.append(prints[own][y[apart]])
        return a, b, crowded

    def batch_of(a: np.ndarray, b: np.ndarray, keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
        key = pa.array(np.append(np.zeros(pairs.shape[1], np.int64), keys), mask=np.arange(pairs.shape[1] + len(keys)) < pairs.shape[1])
        other = pa.array(np.append(pairs[1], prints), mask=np.arange(pairs.shape[1] + len(keys)) >= pairs.shape[1])
        return pa.RecordBatch.from_arrays([key, pa.array(np.append(pairs[0], prints)), other], ["key", "a", "b"])

    none = np.zeros(0, dtype=np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, large = np.zeros((3, 0), dtype=np.int64), None
        for batch in batches:
            own = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "print", "group")]
            rows = np.concatenate((rows, np.stack(own)), axis=1)
            if large is not None:
                more = int(np.searchsorted(rows[0], large, side="right"))
                yield batch_of(none, none, rows[0, :more], rows[1, :more])
                rows = rows[:, more:]
                large = large if not rows.shape[1] else None
            if not rows.shape[1]:
                continue
            # The last key may go on in the next batch.
            last = int(np.searchsorted(rows[0], rows[0, -1]))
            if last:
                a, b, crowded = met(*rows[:, :last])
                crowded = np.concatenate([none, *crowded])
                yield batch_of(np.concatenate(a), np.concatenate(b), rows[0, crowded], rows[1, crowded])
                rows = rows[:, last:]
            if rows.shape[1] > held:
                large = rows[0, 0]
                yield batch_of(none, none, rows[0], rows[1])
                rows = rows[:, :0]
        if rows.shape[1]:
            a, b, crowded = met(*rows)
            crowded = np.concatenate([none, *crowded])
            yield batch_of(np.concatenate(a), np.concatenate(b), rows[0, crowded], rows[1, crowded])

    return run


def _cell_batches(most: int, least: int, lanes: int):
    """Links between the entries of different groups of each cell; what a link joins is one group from then on."""

    def linked(prints: np.ndarray, groups: np.ndarray, wide: np.ndarray) -> list[tuple[int, int]]:
        found, groups = [], groups.copy()
        for at in range(len(prints) - 1):
            others = at + 1 + np.flatnonzero(groups[at + 1 :] != groups[at])
            differing = wide[others] ^ wide[at]
            near = np.bitwise_count(differing).sum(axis=1) <= most
            near &= (differing.view(np.uint8) == 0).sum(axis=1) >= least
            for other in others[near]:
                if groups[other] != groups[at]:
                    found.append((prints[at], prints[other]))
                    groups[groups == groups[other]] = groups[at]
        return found

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((0, 5), dtype=np.int64)
        wide = np.zeros((0, lanes), dtype=np.uint64)

        def links_of(starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            found = [x for s, e in zip(starts, ends) for x in linked(cells[s:e, 3], cells[s:e, 4], wide[s:e])]
            pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            own = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "i", "j", "print", "group")]
            cells = np.concatenate((cells, np.stack(own, axis=1)))
            wide = np.concatenate((wide, _matrix(batch.column("wide"), lanes).view(np.uint64)))
            changes = np.flatnonzero((cells[1:, :3] != cells[:-1, :3]).any(axis=1)) + 1
            if len(changes):  # the last cell may go on in the next batch
                bounds = np.append(0, changes)
                yield links_of(bounds[:-1], bounds[1:])
                cells, wide = cells[changes[-1] :], wide[changes[-1] :]
        if len(cells):
            yield links_of(np.array([0]), np.array([len(cells)]))

    return run


def _verified_batches(most: int, least: int, lanes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differing = _matrix(batch.column("wide_a"), lanes) ^ _matrix(batch.column("wide_b"), lanes)
            near = (differing == 0).sum(axis=1) >= least
            near &= np.bitwise_count(differing).sum(axis=1) <= most
            kept = batch.select(["a", "b"]).filter(pa.array(near))
            yield kept

    return run


def _crowded_links(entries: DataFrame, grouped: DataFrame, most: int, least: int, lanes: int, block: int) -> DataFrame:
    """Links between the ``entries`` (``key``, ``print``) of crowded keys, cut into blocks that meet in cells."""
    placed = entries.join(grouped.select("print", "group"), "print")
    crowds = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("group").alias("lo"), F.max("group").alias("hi"))
    crowds = settle(crowds.where("lo <> hi").select("key", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int").alias("own")
    met = placed.join(crowds, "key").select("key", "print", "group", "blocks", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = met.select("key", "print", "group", "own", other).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "print", "group"
    )
    cells = cells.join(grouped.select("print", "wide"), "print").select("key", "i", "j", "print", "group", "wide")
    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "print")
    return dealt.mapInArrow(_cell_batches(most, least, lanes), "a bigint, b bigint")


def similar_links(
    classes: DataFrame,
    similarity: float = SIMILARITY,
    lanes: int = LANES,
    deals: int = DEALS,
    held: int = HELD_ENTRIES,
    block: int = BLOCK,
) -> DataFrame:
    """Links ``a``, ``b`` between distinct wide fingerprints (``print``, ``wide``) of similar texts.

    The index posts a fingerprint under triples of (position, byte). Pairs that meet under a key are tallied for all
    byte positions they share, those below the least are dropped, and the rest are verified by their bits. Under the
    triples of the first deal all meet the first ones of a key, which joins the large groups; then, under all triples, all
    that meet and are not joined are compared: as pairs where a key has few, else in cells of bounded size.
    """
    most, least = similar_limits(similarity, lanes)
    triples = triples_of(8 * lanes, deals)
    once = len(triples) // deals

    def sorted_index(grouped: DataFrame, own: np.ndarray) -> DataFrame:
        index = grouped.mapInArrow(_index_batches(own, lanes), "key bigint, print bigint, group bigint")
        return index.repartition("key").sortWithinPartitions("key", "print")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(classes.select(F.col("print").alias("a"), F.col("wide").alias("wide_a")), "a")
        both = both.join(classes.select(F.col("print").alias("b"), F.col("wide").alias("wide_b")), "b")
        return both.mapInArrow(_verified_batches(most, least, lanes), "a bigint, b bigint")

    dealt = sorted_index(classes.withColumn("group", F.col("print")), triples[:once])
    pairs = settle(dealt.mapInArrow(_pair_batches, "a bigint, b bigint").distinct())
    first = settle(verified(pairs))
    release(pairs)
    # What the first deal has joined needs no more links among itself.
    known = settle(components(first).select(F.col("node").alias("print"), F.col("component").alias("group")))
    grouped = classes.join(known, "print", "left").withColumn("group", F.coalesce("group", "print"))
    grouped = settle(grouped.select("print", "wide", "group"))
    release(known)
    met = settle(sorted_index(grouped, triples).mapInArrow(_met_batches(held), "key bigint, a bigint, b bigint"))
    few = verified(settle(met.where("b IS NOT NULL").select("a", "b").distinct()))
    crowded = met.where("b IS NULL").select("key", F.col("a").alias("print"))
    return first.unionByName(few).unionByName(_crowded_links(crowded, grouped, most, least, lanes, block))


def keep_one_similar(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    words: int = SIMILAR_WORDS,
    lanes: int = LANES,
    deals: int = DEALS,
) -> DataFrame:
    """The rows of ``docs`` without similar ones: of every component, the row with the smallest id stays.

    Texts are linked when their shingles of ``words`` words have about ``similarity`` or more in common, as their wide
    fingerprints tell. Null ids come last, and of rows with one id, also of repeated rows, one stays; null, empty and
    wordless texts are duplicates of each other. No rows give none.
    """
    with shuffles_freed(docs.sparkSession):
        return _kept_similar(docs, id, text, similarity, words, lanes, deals)


def _kept_similar(
    docs: DataFrame, id: str, text: str, similarity: float, words: int, lanes: int, deals: int
) -> DataFrame:
    source = docs.select(F.struct("*").alias("row"), F.col(id).alias("__id"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    wide = source.mapInArrow(_wide_batches(words, lanes, text), f"{kinds}, __row bigint, __wide binary")
    rows = settle(wide.withColumn("__print", F.xxhash64("__wide")))
    place = F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__row"))
    narrow = rows.select("__id", "__row", "__print")
    classes = settle(
        rows.groupBy(F.col("__print").alias("print")).agg(F.min("__wide").alias("wide")).select("print", "wide")
    )
    linked = similar_links(classes, similarity, lanes, deals)
    reached = _reached(narrow, F.min(place).alias("least"), F.coalesce("least", "first"), 0, linked)
    kept = reached.select(F.col("least.__row").alias("__row")).distinct()
    gone = settle(narrow.select("__row").join(kept, "__row", "left_anti"))
    release(classes)
    return rows.join(gone, "__row", "left_anti").select("row.*")
