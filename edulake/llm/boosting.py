"""A quality classifier: histogram gradient-boosted trees over document statistics.

The trees are complete, so a forest is three flat arrays (feature, threshold and leaf value), and a batch of rows goes
down all of them by index arithmetic. Fitting takes a bounded sample of labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edulake.llm.labels import held_out, training_rows
from edulake.llm.perplexity import measures
from edulake.llm.textops import Slice, Words, mix, released, slices, sum_by_row, whole_text

#: Labelled rows that are learnt from, at most.
MAX_TRAINING_ROWS = 20_000
TREES, DEPTH, BINS = 60, 4, 64
RATE, RIDGE, LEAST_ROWS = 0.2, 1.0, 10
THRESHOLD = 0.5

_CLASSES = ("lower", "upper", "digit", "beyond_ascii", "space", "line_feed", "stop", "mark", "symbol", "other")
_CLASS = np.full(256, _CLASSES.index("other"), dtype=np.int64)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[128:] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[10] = 5
_CLASS[list(b".,;:")] = 6
_CLASS[list(b"!?")] = 7
_CLASS[list(b"#*$%&|<>=+~^_@/\\")] = 8


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def statistics(part: Slice) -> np.ndarray:
    """One row of statistics per text. An empty text has zeros."""
    data, rows, kinds = part.data, part.rows, len(_CLASSES)
    sizes = np.diff(part.offsets)
    row = np.repeat(np.arange(rows), sizes)
    classes = np.bincount(row * kinds + _CLASS[data], minlength=rows * kinds).reshape(rows, kinds)
    words = Words(part, data)
    n_words, characters, symbols, dup_lines, repeated = measures(part)
    lengths = words.ends - words.starts
    hashes = words.hashes()
    with np.errstate(over="ignore"):
        own = mix(hashes + words.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, counts = np.unique(own, return_index=True, return_counts=True)
    distinct = np.bincount(words.row[first], minlength=rows)
    commonest = np.zeros(rows)
    np.maximum.at(commonest, words.row[first], counts)
    same = np.zeros(len(hashes), dtype=np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
    kind = _CLASS[data]
    bare = (kind[words.ends - 1] >= 7) if len(hashes) else np.zeros(0, dtype=bool)
    letters = np.concatenate(([0], np.cumsum(kind <= 3)))
    without = (letters[words.ends] == letters[words.starts]).astype(np.int64)
    lines = classes[:, _CLASSES.index("line_feed")] + 1
    columns = [
        np.log1p(n_words),
        _share(characters, n_words),
        _share(sum_by_row(lengths**2, words.firsts), n_words),
        _share(symbols, n_words),
        _share(dup_lines, lines),
        _share(repeated, n_words),
        _share(distinct, n_words),
        _share(commonest, n_words),
        _share(sum_by_row(same, words.firsts), n_words),
        _share(sum_by_row(bare.astype(np.int64), words.firsts), n_words),
        _share(sum_by_row(without, words.firsts), n_words),
        _share(n_words, lines),
        *[_share(classes[:, k], sizes) for k in range(kinds)],
    ]
    return np.stack(columns, axis=1)


class Forest:
    """Complete trees of one depth: node ``i`` of a level leads to nodes ``2 i + 1`` and ``2 i + 2``."""

    def __init__(self, start: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.start, self.feature, self.threshold, self.value = start, feature, threshold, value

    def margins(self, x: np.ndarray) -> np.ndarray:
        rows, sums = np.arange(len(x)), np.full(len(x), self.start)
        depth = self.value.shape[1].bit_length() - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            sums += value[node - (len(value) - 1)]
        return sums

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Boost ``trees`` trees on the logistic loss, splitting on histograms of gradients and curvatures.

    Without rows of both labels the forest is empty and gives the share of label 1, or 0.5 without any row.
    """
    share = y.mean() if len(y) else 0.5
    start = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    if not len(y) or share in (0.0, 1.0):
        none = np.zeros((0, (1 << depth) - 1))
        return Forest(start, none.astype(np.int64), none, np.zeros((0, 1 << depth)))
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(m)], axis=1)
    cells = np.arange(m) * bins + binned
    margin = np.full(n, start)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curvature = p - y, p * (1 - p)
        feature = np.zeros((1 << depth) - 1, dtype=np.int64)
        threshold = np.full((1 << depth) - 1, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            base, width = (1 << level) - 1, 1 << level
            flat = ((node - base)[:, None] * (m * bins) + cells).ravel()

            def histogram(weights: np.ndarray | None) -> np.ndarray:
                repeated = None if weights is None else np.repeat(weights, m)
                return np.bincount(flat, repeated, width * m * bins).reshape(width, m, bins)

            g, h, c = (np.cumsum(histogram(w), axis=2) for w in (gradient, curvature, None))
            gs, hs, cs = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (gs - g) ** 2 / (hs - h + RIDGE) - gs**2 / (hs + RIDGE)
            gain[(c < LEAST_ROWS) | (cs - c < LEAST_ROWS)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[base + k], threshold[base + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - ((1 << depth) - 1)
        sums = np.bincount(leaf, gradient, 1 << depth), np.bincount(leaf, curvature, 1 << depth)
        value = -RATE * sums[0] / (sums[1] + RIDGE)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(start, np.array(features), np.array(thresholds), np.array(values))


@released
def _statistic_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "__text"):
            x = statistics(part)
            found = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("label"), found], ["id", "label", "x"])


def _score_batches(forest: Forest):
    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [n for n in batch.schema.names if n != "__text"]
            for part in slices(batch, "__text"):
                scores = pa.array(forest.scores(statistics(part)))
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), scores], [*kept, "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, id: str, text: str, most: int = MAX_TRAINING_ROWS) -> Forest:
    """The forest of a bounded sample of labelled rows, of which only the statistics return to the driver."""
    rows = training_rows(docs, labels, "quality", most, id, text)
    kind = rows.schema["__id"].dataType.simpleString()
    found = rows.mapInArrow(_statistic_batches, f"id {kind}, label int, x array<double>").toArrow()
    found = found.sort_by([("id", "ascending"), ("label", "ascending")]).combine_chunks()
    y = found.column("label").to_numpy().astype(float)
    if not len(y):
        return fit(np.zeros((0, 1)), y)
    return fit(found.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1), y)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    most: int = MAX_TRAINING_ROWS,
) -> DataFrame:
    """Per row: the id, ``held_out``, ``score`` (0 to 1, higher for label 1) and ``predicted`` (1 from ``threshold``).

    Nothing but the text is scored; null texts count as empty and get a score like any other. Rows with null ids are
    held out, repeated rows get the same score, and without labels of both kinds all scores are the share of label 1.
    """
    forest = train(docs, labels, id, text, most)
    rows = docs.select(F.col(id).alias("__id"), whole_text(F.col(text)).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    scored = rows.mapInArrow(_score_batches(forest), f"__id {kind}, score double")
    return scored.select(
        F.col("__id").alias(id),
        held_out(F.col("__id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
