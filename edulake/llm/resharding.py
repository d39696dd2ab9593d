"""Resharding by minimum-cost flow: from old shard sizes and new capacities to the block transfers that move fewest bytes.

A block is what an old shard holds of one size class in one bucket of its rows. Blocks are counted by Spark; their number
is bounded by old shards x 64 classes x ``BUCKETS``, however many rows there are, and only their sizes reach the driver.
There a flow from old shards to new ones, with a price for every byte that changes its shard, says how many bytes go
where; blocks follow the flow, the largest first, and a few small ones even out what whole blocks leave uneven. Rows then
find their shard through a table of blocks.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edulake.session import settle

#: Buckets of rows in an old shard and size class.
BUCKETS = 64
#: Shards may differ by one part in so many of their mean capacity, where blocks allow.
EVEN = 1000
#: Parts that a shard's rows are numbered in.
PARTS = 4096
#: The old shard of rows that had none.
NEW = -1

Price = Callable[[int, int], int]


def moved(old: int, new: int) -> int:
    """The price of a byte: nothing for staying, one for moving."""
    return int(old != new)


def solve(supply: dict[int, int], capacity: Sequence[int], price: Price = moved) -> dict[tuple[int, int], int]:
    """Bytes from every old shard to every new one, at the least total price; all supply goes out, no capacity is passed.

    Shortest augmenting paths with potentials, over shards only. Prices are not negative.
    """
    if sum(supply.values()) > sum(capacity):
        raise ValueError("the new shards cannot hold what the old ones have")
    olds = sorted(supply)
    m, n = len(olds), len(capacity)
    source, sink = m + n, m + n + 1
    heads: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(m + n + 2)]

    def arc(a: int, b: int, most: int, unit: int) -> None:
        for start, end, r, c in ((a, b, most, unit), (b, a, 0, -unit)):
            out[start].append(len(heads))
            heads.append(end)
            room.append(r)
            cost.append(c)

    for i, old in enumerate(olds):
        arc(source, i, supply[old], 0)
        for j in range(n):
            arc(i, m + j, supply[old], price(old, j))
    for j, most in enumerate(capacity):
        arc(m + j, sink, most, 0)
    potential = [0] * (m + n + 2)
    while True:
        distance: dict[int, int] = {source: 0}
        through: dict[int, int] = {}
        queue, done = [(0, source)], set()
        while queue:
            far, a = heapq.heappop(queue)
            if a in done:
                continue
            done.add(a)
            for e in out[a]:
                b = heads[e]
                if room[e] > 0 and b not in done:
                    further = far + cost[e] + potential[a] - potential[b]
                    if b not in distance or further < distance[b]:
                        distance[b], through[b] = further, e
                        heapq.heappush(queue, (further, b))
        if sink not in distance:
            break
        longest = max(distance.values())
        for a in range(m + n + 2):
            potential[a] += distance.get(a, longest)
        path, a = [], sink
        while a != source:
            path.append(through[a])
            a = heads[through[a] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    return {
        (olds[i], heads[e] - m): room[e ^ 1]
        for i in range(m)
        for e in out[i]
        if m <= heads[e] < m + n and room[e ^ 1] > 0 and e % 2 == 0
    }


def place(blocks: Sequence[tuple[int, int, int, int]], capacity: Sequence[int], price: Price = moved) -> list[int]:
    """The new shard of every block (old shard, class, bucket, size)."""
    supply: dict[int, int] = defaultdict(int)
    for old, *_, size in blocks:
        supply[old] += size
    left: dict[int, dict[int, int]] = defaultdict(dict)
    for (old, new), amount in solve(supply, capacity, price).items():
        left[old][new] = amount
    target = [0] * len(blocks)
    held: list[list[tuple[int, int]]] = [[] for _ in capacity]
    over = [-c for c in capacity]
    for k in sorted(range(len(blocks)), key=lambda k: (-blocks[k][3], blocks[k])):
        old, size = blocks[k][0], blocks[k][3]
        new = max(left[old], key=lambda j: (left[old][j], -price(old, j), -j))
        left[old][new] -= size
        target[k] = new
        over[new] += size
        held[new].append((size, k))
    for own in held:
        own.sort()
    _even_out(target, held, over, sum(capacity) // max(len(capacity), 1) // EVEN)
    return target


def _even_out(target: list[int], held: list[list[tuple[int, int]]], over: list[int], slack: int) -> None:
    """Send blocks from the fullest shard to the emptiest while that at least halves the difference.

    A block, or a block against a smaller one, of the smallest that do. Every step lessens the sum of squares.
    """
    while True:
        high = max(range(len(over)), key=lambda j: (over[j], -j))
        low = min(range(len(over)), key=lambda j: (over[j], j))
        gap = over[high] - over[low]
        if gap <= max(slack, 1):
            return
        least, most = -(-gap // 4), gap * 3 // 4
        rich, poor = held[high], held[low]
        at = bisect_left(rich, (least, -1))
        if at < len(rich) and rich[at][0] <= most:
            swap = rich[at], None
        else:
            swap = None
            for block in rich[at:]:
                found = bisect_left(poor, (block[0] - most, -1))
                if found < len(poor) and block[0] - poor[found][0] >= least:
                    swap = block, poor[found]
                    break
        if swap is None:
            return
        for block, start, end in ((swap[0], high, low), (swap[1], low, high)):
            if block is not None:
                del held[start][bisect_right(held[start], block) - 1]
                insort(held[end], block)
                over[start] -= block[0]
                over[end] += block[0]
                target[block[1]] = end


def even_capacities(total: int, shards: int) -> list[int]:
    """Capacities that hold ``total`` and differ by one at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def _block(old: Column, size: Column, spot: Column) -> list[Column]:
    return [
        F.coalesce(old.cast("int"), F.lit(NEW)).alias("__old"),
        F.length(F.bin(size)).alias("__class"),
        F.pmod(F.xxhash64(spot), F.lit(BUCKETS)).cast("int").alias("__bucket"),
    ]


def plan(
    rows: DataFrame,
    old: Column,
    size: Column,
    spot: Column,
    shards: int,
    capacity: Sequence[int] | None = None,
    price: Price = moved,
) -> DataFrame:
    """The blocks of ``rows`` with their new shard: ``__old``, ``__class``, ``__bucket``, ``bytes``, ``n_rows``, ``shard``.

    ``old`` is a row's shard so far (null: it had none, and moves wherever it goes), ``size`` its bytes, above 0, and
    ``spot`` any number that spreads rows and stays the same when a task runs again. ``capacity`` has one entry for each
    of ``shards``, by default equal ones.
    """
    spark = rows.sparkSession
    found = rows.select(*_block(old, size, spot), size.alias("__size")).groupBy("__old", "__class", "__bucket")
    blocks = found.agg(F.sum("__size").alias("bytes"), F.count("*").alias("n_rows")).collect()
    blocks.sort(key=lambda b: tuple(b)[:3])
    sizes = [tuple(b)[:4] for b in blocks]
    if capacity is None:
        capacity = even_capacities(sum(s[3] for s in sizes), shards)
    if len(capacity) != shards:
        raise ValueError("one capacity for each shard")
    target = place(sizes, capacity, price)
    return spark.createDataFrame(
        [(*b, new) for b, new in zip(blocks, target, strict=True)],
        "__old int, __class int, __bucket int, bytes bigint, n_rows bigint, shard int",
    )


def assign(rows: DataFrame, blocks: DataFrame, old: Column, size: Column, spot: Column) -> DataFrame:
    """``row``, ``old_shard``, ``shard`` and ``moved`` for every row of the table that ``blocks`` was planned for.

    The number of blocks is bounded by the numbers of shards, classes and buckets, so they are broadcast.
    """
    row = F.struct(*[rows[c] for c in rows.columns]).alias("row")
    known = rows.select(row, *_block(old, size, spot))
    table = F.broadcast(blocks.select("__old", "__class", "__bucket", "shard"))
    return known.join(table, ["__old", "__class", "__bucket"]).select(
        "row",
        F.when(F.col("__old") != NEW, F.col("__old")).alias("old_shard"),
        "shard",
        (F.col("__old") != F.col("shard")).alias("moved"),
    )


def numbered(rows: DataFrame, shard: str, spot: str, slot: str = "slot") -> DataFrame:
    """Rows with their number in their shard, from 0 without gaps, in the order of a hash of ``spot``.

    A shard is cut into ``PARTS`` by the hash; counts say where a part begins, so no task sees a whole shard. Counts are
    bounded by shards x ``PARTS`` and broadcast.
    """
    hashed = rows.withColumn("__hash", F.xxhash64(spot)).withColumn(
        "__part", F.pmod("__hash", F.lit(PARTS)).cast("int")
    )
    counts = hashed.groupBy(shard, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(shard, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    order = Window.partitionBy(shard, "__part").orderBy("__hash", spot)
    ranked = hashed.withColumn("__rank", F.row_number().over(order) - 1)
    return (
        ranked.join(F.broadcast(counts), [shard, "__part"])
        .withColumn(slot, F.col("__before") + F.col("__rank"))
        .drop("__hash", "__part", "__rank", "__before")
    )


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """A table stored in folders ``shard=0`` on, with ``__spot``, a number from the file and place of each row."""
    rows = spark.read.parquet(folder)
    spot = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    return rows.select("*", spot.alias("__spot"))


def rewrite(
    spark: SparkSession,
    folder: str,
    target: str,
    size: Column,
    shards: int,
    capacity: Sequence[int] | None = None,
    price: Price = moved,
) -> DataFrame:
    """Reshard a stored table: the shards that give or get rows are written anew under ``target``, the others stay.

    Gives ``shard``, ``path``, ``rewritten`` for every new shard with rows. Nothing under ``folder`` is changed, so
    readers of the old layout are not disturbed and a failed run can be repeated into another ``target``.
    """
    rows = stored(spark, folder)
    old, spot = F.col("shard"), F.col("__spot")
    blocks = plan(rows, old, size, spot, shards, capacity, price)
    changed = blocks.where("__old <> shard")
    affected = {r[0] for r in changed.select("shard").union(changed.select("__old")).distinct().collect()}
    found = {r[0] for r in blocks.select("shard").distinct().collect()}
    if affected:
        names = [c for c in rows.columns if c not in ("shard", "__spot")]
        kept = rows.where(F.coalesce(old, F.lit(NEW)).isin(list(affected)))
        dealt = assign(kept, blocks, old, size, spot)
        # Parts of a shard go to different tasks, so that a large shard has several writers.
        dealt = dealt.repartition("shard", F.pmod(F.xxhash64("row.__spot"), F.lit(16)))
        dealt.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "shard").write.partitionBy("shard").parquet(target)
    manifest = [
        (j, f"{(target if j in affected else folder).rstrip('/')}/shard={j}", j in affected) for j in sorted(found)
    ]
    return spark.createDataFrame(manifest, "shard int, path string, rewritten boolean")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The rows of all shards of a manifest, with their ``shard``. One path for each shard reaches the driver."""
    paths = manifest.orderBy("shard").collect()
    parts = [spark.read.parquet(p.path).withColumn("shard", F.lit(p.shard)) for p in paths]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def shard_documents(docs: DataFrame, old: Column, shards: int, text: str = "text", keep: Sequence[str] = ("doc_id",)):
    """Documents dealt out to shards of equal bytes: the ``keep`` columns, ``size`` (UTF-8 bytes and 1), ``text_crc32``,
    ``old_shard``, ``shard``, ``moved`` and ``slot``.

    A null text counts as empty. The narrow columns are settled with the place where each row was read, so repeated
    rows and null ids are spread like others and every pass sees the same places. An empty table gives no rows.
    """
    body = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    narrow = settle(
        docs.select(
            *[F.col(c).alias(f"k{k}") for k, c in enumerate(keep)],
            (F.octet_length(body) + 1).cast("bigint").alias("size"),
            F.crc32(body).alias("text_crc32"),
            old.cast("int").alias("old"),
            F.monotonically_increasing_id().alias("spot"),
        )
    )
    key = (F.col("old"), F.col("size"), F.col("spot"))
    dealt = assign(narrow, plan(narrow, *key, shards), *key)
    flat = dealt.select(
        *[F.col(f"row.k{k}") for k in range(len(keep))],
        "row.size",
        "row.text_crc32",
        "old_shard",
        "shard",
        "moved",
        "row.spot",
    )
    slots = numbered(flat, "shard", "spot")
    return slots.select(
        *[F.col(f"k{k}").alias(c) for k, c in enumerate(keep)],
        "size",
        "text_crc32",
        "old_shard",
        "shard",
        "moved",
        "slot",
    )
