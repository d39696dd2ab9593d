"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is its lower-cased words joined by single spaces, then an end. Every byte is eight binary decisions, each with a
context tree of its own over the bytes before. A node's Krichevsky-Trofimov estimate is mixed with those of its
children, so all depths take part, weighted by how well they have coded the corpus:
``log P(node) = log(1/2 KT(node) + 1/2 prod P(children))``.

Spark counts the byte n-grams of all texts, those of held-out ones with zero. The trees hold every context of the corpus:
their nodes are rows, weighted from the longest contexts to the root and mixed on the way back, a join for each depth.
What comes out is the log probability of every n-gram of any text. The n-grams that make up at least one part in
``MAX_GRAMS`` of all bytes are sent to the tasks; texts meet the others in a join.

The baseline, a smoothed word model, needs the count of every word. Words that make up at least one part in
``MAX_FREQUENT`` of all tokens are sent along; all others meet their counts in a join by their 64-bit hashes.

``fit`` gives a tree of bounded size for one machine, in which the rarer children of a node are one child.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edulake.llm.grams import Frequent, Tally, counted_batch, gram_keys, gram_sums, lists_of
from edulake.llm.textops import LOWER, Slice, Words, released, slices, sum_by_row, whole_text
from edulake.session import settle

DEPTH = 5
MAX_CONTEXTS = 40_000
#: Steps of the histogram of context counts to a factor of two.
_STEPS = 64
MAX_FREQUENT = 1 << 19
MAX_GRAMS = 1 << 21
GRAM, TOKEN = 0, 1
#: Stands for the end of a text among the hashes of tokens.
_END = np.uint64(0x0123456789ABCDEF)


def held_out(id: Column) -> Column:
    """True for rows that the model does not learn from: remainder 0 of ten by checksum of the id, and null ids."""
    return F.coalesce(F.crc32(id.cast("string")) % 10 == 0, F.lit(True))


def token_text(part: Slice) -> tuple[Slice, Words]:
    """The slice with its texts lower-cased and their words joined by single spaces, and their words."""
    data = LOWER[part.data]
    words = Words(part, data)
    sizes = words.ends - words.starts
    last = np.zeros(len(sizes), dtype=bool)
    filled = words.counts > 0
    last[words.firsts[1:][filled] - 1] = True
    spaced = sizes + ~last
    ends = np.cumsum(spaced)
    joined = np.full(int(spaced.sum()), 0x20, dtype=np.uint8)
    inside = np.repeat(ends - spaced - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    joined[inside] = data[np.repeat(words.starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    offsets = np.append(0, np.cumsum(sum_by_row(spaced, words.firsts)))
    return Slice(part.batch, part.first, part.last, joined, offsets), words


def _count_batches(depth: int):
    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, tokens = Tally(), Tally()
        for batch in batches:
            learnt = "__learnt" in batch.schema.names
            for part in slices(batch, "__text"):
                own, words = token_text(part)
                keys, counts = gram_keys(own, own.data, depth + 1, end=True)
                hashes = np.append(words.hashes(), np.full(part.rows, _END))
                if learnt:
                    chosen = part.column("__learnt").to_numpy(zero_copy_only=False)
                    hashes = hashes[np.append(chosen[words.row], chosen)]
                    of_key = np.repeat(chosen, counts)
                    other = np.unique(keys[~of_key])
                    full = grams.add(other, np.zeros(len(other), dtype=np.int64))
                    if full is not None:
                        yield counted_batch(full, GRAM)
                    keys = keys[of_key]
                full = grams.add(keys)
                if full is not None:
                    yield counted_batch(full, GRAM)
                full = tokens.add(hashes)
                if full is not None:
                    yield counted_batch(full, TOKEN)
        yield counted_batch(grams.take(), GRAM)
        yield counted_batch(tokens.take(), TOKEN)

    return run


def corpus_counts(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Counts over the column ``__text``: ``kind`` (byte n-gram of ``depth + 1``, or token), ``key`` and ``n``.

    Of rows that a column ``__learnt`` excludes, the n-grams are there with zero, the tokens are not.
    """
    used = [c for c in ("__text", "__learnt") if c in rows.columns]
    found = rows.select(*used).mapInArrow(_count_batches(depth), "kind int, key bigint, n bigint")
    return settle(found.groupBy("kind", "key").agg(F.sum("n").alias("n")))


def _ln_gamma(x: Column) -> Column:
    lift = x
    for step in range(1, 8):
        lift = lift * (x + F.lit(float(step)))
    y = x + F.lit(8.0)
    series = (y - 0.5) * F.ln(y) - y + F.lit(float(0.5 * np.log(2 * np.pi))) + 1 / (12 * y) - 1 / (360 * y * y * y)
    return series - F.ln(lift)


def gram_logs(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``key``, ``n`` and ``log10``, the log10 probability of the last byte after those before, of every n-gram.

    A node is a context and the bits of the next byte so far, as one number: the context, then a one and these bits. The
    tree of ``grams`` (``key``, ``n``) holds all contexts; where counts are zero, zeros and ones are alike.
    """
    byte = F.col("key").bitwiseAND(F.lit(255)).cast("int")
    nodes = [
        F.struct(
            F.col("key").bitwiseAND(F.lit(~255)).bitwiseOR(F.lit(1 << bit).bitwiseOR(F.shiftright(byte, 8 - bit)).cast("bigint")).alias("node"),
            F.shiftright(byte, 7 - bit).bitwiseAND(F.lit(1)).alias("bit"),
        )
        for bit in range(8)
    ]
    own = grams.select("n", F.inline(F.array(*nodes)))
    half = float(np.log(0.5))
    kt = _ln_gamma(F.col("zeros") + 0.5) + _ln_gamma(F.col("ones") + 0.5) - float(np.log(np.pi))
    kt = kt - _ln_gamma(F.col("zeros") + F.col("ones") + 1.0)
    level = own.groupBy("node").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("zeros"),
        F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("ones"),
    )
    levels = [settle(level.withColumn("kt", kt).withColumn("weighted", F.col("kt")))]
    for d in range(depth - 1, -1, -1):
        up = F.col("node").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("node")
        sums = [F.sum(c).alias(c) for c in ("zeros", "ones")]
        level = levels[-1].groupBy(up).agg(*sums, F.sum("weighted").alias("below")).withColumn("kt", kt)
        more, less = F.greatest("kt", "below"), F.least("kt", "below")
        weighted = F.lit(half) + more + F.log1p(F.exp(less - more))
        levels.append(settle(level.select("node", "zeros", "ones", "kt", weighted.alias("weighted"))))
    # From the root down: what the shorter contexts add, and the weight that is left to the longer ones.
    p = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    above = None
    for d, level in enumerate(levels[::-1]):
        stop = F.exp(F.lit(half) + F.col("kt") - F.col("weighted")) if d < depth else F.lit(1.0)
        if above is None:
            placed = level.withColumn("added", F.lit(0.0)).withColumn("left", F.lit(1.0))
        else:
            up = F.col("node").bitwiseAND(F.lit((1 << 8 * d) - 1))
            placed = level.withColumn("up", up).join(above.withColumnRenamed("node", "up"), "up")
        placed = placed.select(
            "node", (F.col("added") + F.col("left") * stop * p).alias("added"), (F.col("left") * (1 - stop)).alias("left")
        )
        above = settle(placed) if d < depth else placed
    one = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("added")))
    prefix = F.col("node").bitwiseAND(F.lit(255)).cast("int")
    tables = above.select(F.shiftright("node", 8).alias("context"), F.struct(prefix.alias("prefix"), one.alias("one")).alias("bit"))
    # At most 255 bits for a context.
    tables = tables.groupBy("context").agg(F.map_from_entries(F.collect_list("bit")).alias("bits"))
    met = grams.withColumn("context", F.shiftright("key", 8)).join(tables, "context")
    logs = F.lit(0.0)
    for bit in range(8):
        own = F.element_at("bits", F.lit(1 << bit).bitwiseOR(F.shiftright(byte, 8 - bit)))
        logs = logs + F.log10(F.when(F.shiftright(byte, 7 - bit).bitwiseAND(F.lit(1)) == 1, own).otherwise(1 - own))
    return settle(met.select("key", "n", logs.alias("log10")))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series eight steps up."""
    lift = np.zeros_like(x)
    for step in range(8):
        lift += np.log(x + step)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - lift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - np.log(np.pi) - _log_gamma(zeros + ones + 1)


class ContextTree:
    """Contexts as nodes of one tree, with log10 probabilities of every byte after each of them.

    ``child[inner[node], byte]`` is the node whose context goes one byte further back, or -1; leaves share a row. Row
    ``node`` of ``log10`` holds the mixture for positions whose longer contexts are not in the tree.
    """

    def __init__(self, depth: int, contexts: np.ndarray, depths: np.ndarray, counts: np.ndarray):
        """``contexts`` (last byte lowest) and ``depths``, sorted by depth from the root on; ``counts`` of next bytes."""
        self.depth = depth
        size = len(contexts)
        parent = np.zeros(size, dtype=np.int64)
        known = {(0, 0): 0}
        for node in range(1, size):
            d, context = int(depths[node]), int(contexts[node])
            parent[node] = known[d - 1, context & ((1 << 8 * (d - 1)) - 1)]
            known[d, context] = node
        levels = [np.flatnonzero(depths == d) for d in range(int(depths.max()) + 1)]
        inner = np.zeros(size, dtype=bool)
        inner[parent[1:]] = True
        # Row 0 of the table is that of all leaves.
        self.inner = np.where(inner, np.cumsum(inner), 0).astype(np.int32)
        self.child = np.full((int(inner.sum()) + 1, 256), -1, dtype=np.int32)
        further = (contexts[1:] >> 8 * np.maximum(depths[1:] - 1, 0)) & 0xFF
        self.child[self.inner[parent[1:]], further] = np.arange(1, size)
        # What a node's own children leave, the rarer ones, is one more child.
        rest = counts.copy()
        np.subtract.at(rest, parent[1:], counts[1:])
        np.maximum(rest, 0, out=rest)
        # Where the last two bytes lead, at once.
        one = self.child[self.inner[0]]
        two = np.where(one >= 0, self.child[self.inner[one]].T, -1).ravel()
        self.second = np.where(two >= 0, two, np.tile(np.maximum(one, 0), 256)).astype(np.int32)
        self.goes_on = two >= 0
        self.log10 = np.zeros((size, 256), dtype=np.float32)
        # The eight binary decisions of a byte, one after the other, each for all its 1 to 128 prefixes at once.
        for bit in range(8):
            for first in range(0, 1 << bit, 16):
                self._mix(bit, first, min(16, 1 << bit), counts, rest, parent, levels, inner)

    def _mix(self, bit: int, first: int, width: int, counts, rest, parent, levels, inner) -> None:
        span = 256 >> bit
        columns = slice(first * span, (first + width) * span)

        def split(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            halves = table[:, columns].reshape(len(table), width, 2, span // 2).sum(axis=3, dtype=float)
            return halves[:, :, 0], halves[:, :, 1]

        zeros, ones = split(counts)
        rest_zeros, rest_ones = split(rest)
        own, left = _log_kt(zeros, ones), _log_kt(rest_zeros, rest_ones)
        weighted, below = own.copy(), np.where(inner[:, None], left, 0.0)
        half = np.log(0.5)
        for nodes in levels[::-1]:
            deep = nodes[inner[nodes]]
            weighted[deep] = np.logaddexp(half + own[deep], half + below[deep])
            if len(nodes) and nodes[0] > 0:
                np.add.at(below, parent[nodes], weighted[nodes])
        stop = np.where(inner[:, None], np.exp(half + own - weighted), 1.0)
        p = (ones + 0.5) / (zeros + ones + 1)
        p_rest = (rest_ones + 0.5) / (rest_zeros + rest_ones + 1)
        # From the root down: what the shorter contexts add, and the weight that is left to the longer ones.
        added, left_over = np.zeros_like(p), np.ones_like(p)
        for nodes in levels:
            if nodes[0] > 0:
                up = parent[nodes]
                added[nodes] = added[up] + left_over[up] * stop[up] * p[up]
                left_over[nodes] = left_over[up] * (1 - stop[up])
        one = added + left_over * (stop * p + (1 - stop) * np.where(inner[:, None], p_rest, p))
        one = np.clip(one, 1e-12, 1 - 1e-12)
        both = np.log10(np.stack((1 - one, one), axis=2)).reshape(len(one), -1)
        self.log10[:, columns] += np.repeat(both, span // 2, axis=1).astype(np.float32)

    def scores(self, part: Slice) -> np.ndarray:
        """log10 probability of each text of the slice with its end."""
        keys, counts = gram_keys(part, part.data, self.depth + 1, end=True)
        last_two = ((keys >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int32)
        node = self.second[last_two]
        alive = np.flatnonzero(self.goes_on[last_two])
        for step in range(3, self.depth + 1):
            before = ((keys[alive] >> np.uint64(8 * step)) & np.uint64(0xFF)).astype(np.int64)
            further = self.child[self.inner[node[alive]], before]
            alive = alive[further >= 0]
            node[alive] = further[further >= 0]
        logs = self.log10[node, (keys & np.uint64(0xFF)).astype(np.int64)].astype(float)
        return sum_by_row(logs, np.append(0, np.cumsum(counts)))


def fit(counts: DataFrame, depth: int = DEPTH, max_contexts: int = MAX_CONTEXTS) -> ContextTree:
    """The tree of the counted n-grams, of ``depth`` 2 at least. At most 256 rows for each of ``max_contexts`` contexts return to the driver.

    A histogram of all contexts by count tells the least count that is taken; ties go together, in or out.
    """
    grams = counts.where(F.col("kind") == GRAM)
    levels = [
        grams.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n"))
        for d in range(depth)
    ]
    levels = [
        settle(level.select("key", "n", F.shiftrightunsigned("key", 8).alias("context")))
        for level in [*levels, grams.select("key", "n")]
    ]
    sums = [level.groupBy("context").agg(F.sum("n").alias("all")) for level in levels]
    step = F.floor(F.log2("all") * F.lit(_STEPS)).alias("step")
    steps = None
    for own in sums[1:]:
        own = own.select(step)
        steps = own if steps is None else steps.unionByName(own)
    # One row per step of the histogram, of which there are at most 64 * _STEPS.
    number, least = 1, None
    for row in sorted(steps.groupBy("step").count().collect(), key=lambda x: -x["step"]):
        number += row["count"]
        if number > max_contexts:
            break
        least = row["step"]
    contexts, depths, rows, cells = [], [], [], []
    for d, (level, own) in enumerate(zip(levels, sums)):
        kept = own if d == 0 else own.where(F.lit(False) if least is None else step >= F.lit(least))
        table = level.join(kept, "context").select("context", F.col("key").bitwiseAND(F.lit(255)).alias("byte"), "n")
        table = table.toArrow()
        context, place = np.unique(table.column("context").to_numpy().astype(np.int64), return_inverse=True)
        rows.append(place + sum(map(len, contexts)))
        contexts.append(context)
        depths.append(np.full(len(context), d))
        cells.append((table.column("byte").to_numpy(), table.column("n").to_numpy()))
    dense = np.zeros((max(sum(map(len, contexts)), 1), 256), dtype=np.float32)
    for row, (byte, n) in zip(rows, cells):
        dense[row, byte.astype(np.int64)] = n
    if not len(contexts[0]):
        contexts, depths = [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)]
    return ContextTree(depth, np.concatenate(contexts), np.concatenate(depths), dense)


def _score_batches(model, total: int, distinct: int, depth: int):
    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, frequent = model.value
        scale = np.log10(total + 0.1 * (distinct + 1))
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "__text"):
                own, words = token_text(part)
                rows = part.rows
                hashes = np.append(words.hashes(), np.full(rows, _END))
                row = np.append(words.row, np.arange(rows))
                known, counts = frequent.find(hashes)
                base = np.bincount(row[known], np.log10(counts + 0.1), rows)
                n_known = np.bincount(row[known], minlength=rows)
                keys, n_keys = gram_keys(own, own.data, depth + 1, end=True)
                score, *rare_grams = gram_sums(keys, np.repeat(np.arange(rows), n_keys), rows, logs)
                tokens = words.counts + 1
                arrays = [
                    pa.array(np.arange(number, number + rows)),
                    part.column("__id"),
                    pa.array(tokens.astype(np.int64)),
                    pa.array(n_known.astype(np.int64)),
                    pa.array(base - tokens * scale),
                    pa.array(score),
                    pa.array((np.diff(own.offsets) + 1).astype(np.int64)),
                    # Rare tokens and n-grams, by row, for the joins with their counts and logs.
                    lists_of(hashes[~known], row[~known], rows),
                    lists_of(*rare_grams, rows),
                ]
                number += rows
                yield pa.RecordBatch.from_arrays(
                    arrays, ["row", "id", "n_tokens", "n_known", "base", "score", "n_bytes", "rare", "rare_grams"]
                )

    return run


def score(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    depth: int = DEPTH,
    max_frequent: int = MAX_FREQUENT,
    max_grams: int = MAX_GRAMS,
) -> DataFrame:
    """Per row: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``,
    ``n_bytes`` and ``bits_per_byte``, the code length of a byte.

    Tokens are the lower-cased words and one end. ``base_score`` sums log10((c + 0.1) / (N + 0.1 (V + 1))) over them;
    ``score`` is the log10 probability of the text by the tree of all contexts. Null texts are empty: an end alone. Null
    ids are held out, repeated rows each count and get their row, and without training rows the scores are those of an
    empty model. At most ``max_frequent`` tokens and ``max_grams`` n-grams are sent to the tasks; the rest is joined.
    """
    learnt = ~held_out(F.col("__id"))
    rows = docs.select(F.col(id).alias("__id"), whole_text(F.col(text)).alias("__text")).withColumn("__learnt", learnt)
    counts = corpus_counts(rows, depth)
    tokens = counts.where(F.col("kind") == TOKEN).select(F.col("key").alias("token"), F.col("n").alias("c"))
    total, distinct = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    common = tokens.where(F.col("c") * F.lit(max_frequent) >= F.lit(total)).toArrow()
    frequent = Frequent(common.column("token").to_numpy(), common.column("c").to_numpy())
    grams = gram_logs(counts.where(F.col("kind") == GRAM).select("key", "n"), depth)
    n_bytes = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = grams.where((F.col("n") > 0) & (F.col("n") * F.lit(max_grams) >= F.lit(n_bytes))).toArrow()
    logs = Frequent(common.column("key").to_numpy(), common.column("log10").to_numpy())
    model = docs.sparkSession.sparkContext.broadcast((logs, frequent))
    kind = rows.schema["__id"].dataType.simpleString()
    schema = (
        f"row bigint, id {kind}, n_tokens bigint, n_known bigint, base double, score double, n_bytes bigint, "
        "rare array<bigint>, rare_grams array<bigint>"
    )
    scored = settle(rows.select("__id", "__text").mapInArrow(_score_batches(model, total, distinct, depth), schema))
    each = scored.select("row", F.explode("rare").alias("token"))
    met = each.join(tokens, "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rest = met.groupBy("row").agg(
        F.sum(F.log10(F.col("c") + F.lit(0.1))).alias("rest"), F.count_if(F.col("c") > 0).alias("more")
    )
    each = scored.select("row", F.explode("rare_grams").alias("key"))
    left = each.join(grams.select("key", "log10"), "key").groupBy("row").agg(F.sum("log10").alias("left"))
    whole = F.col("score") + F.coalesce("left", F.lit(0.0))
    narrow = scored.drop("rare", "rare_grams")
    return narrow.join(rest, "row", "left").join(left, "row", "left").select(
        F.col("id").alias(id),
        held_out(F.col("id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        whole.alias("score"),
        "n_bytes",
        (-whole / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
