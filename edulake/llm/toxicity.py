"""A convolutional text classifier for toxicity, trained in numpy.

A word's vector is the sum of the hashed embeddings of the word and of its beginnings; hashes that few training texts
hold have none, so that rare words are not learnt by heart and other words do not share their place. Filters of several widths slide
over the words, the largest response of each filter over the whole text is kept, and a logistic unit joins them.
Training takes a bounded sample of labelled rows; scoring reads every whole text in the tasks that hold it. The thresholds
are those of all labelled rows that training has not seen, as counted by Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edulake.llm.labels import held_out, training_rows
from edulake.llm.textops import LOWER, Slice, Words, released, slices, span_hashes, whole_text
from edulake.session import settle

#: Labelled rows, and words in them, that are learnt from at most.
MAX_TRAINING_ROWS = 6000
MAX_TRAINING_WORDS = 4_000_000
#: Hashes with an embedding: those in at least so many training texts, and no more than fit into 16 bits.
LEAST_TEXTS, MAX_EMBEDDINGS, SIZE = 4, 65_000, 8
_SLOT_BITS = 20
WIDTHS, FILTERS = (1, 2, 3), 8
#: Bytes of the beginnings of a word that have embeddings of their own.
BEGINNINGS = (3, 4, 5)
EPOCHS, BATCH, RATE = 8, 32, 0.1
#: Share of the hashes that training leaves out at random, so that no single one decides alone.
DROPPED = 0.5
THRESHOLD = 0.7
#: One row in so many of the sample is set apart to calibrate the thresholds, with all rows outside the sample, and a
#: language needs so many toxic ones of them.
CALIBRATION, LEAST_TOXIC = 5, 10
#: Thresholds that are tried.
CUTS = np.unique(np.concatenate((np.linspace(0.05, 0.95, 19), [THRESHOLD])))


def word_hashes(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each lower-cased word and of its beginnings, and the number of words of each text."""
    data = LOWER[part.data]
    words = Words(part, data)
    ends = [words.ends, *[np.minimum(words.starts + n, words.ends) for n in BEGINNINGS]]
    # Beginnings and whole words are kept apart.
    hashes = [span_hashes(data, words.starts, e) ^ np.uint64(k > 0) for k, e in enumerate(ends)]
    return np.stack(hashes, axis=1).reshape(-1, 1 + len(BEGINNINGS)), words.counts


class Vocabulary:
    """Places of hashes in the table of embeddings; place 0 stands for all others."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.append(np.uint64(0), np.sort(hashes.astype(np.uint64)))
        self.slots = np.zeros(1 << _SLOT_BITS, dtype=np.uint16)
        slots = (self.hashes[1:] >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        self.slots[slots[::-1]] = np.arange(len(hashes), 0, -1)
        # Sorted hashes of one slot follow each other.
        self.deepest = int(np.bincount(slots).max()) if len(slots) else 0

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = self.slots[(hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)].astype(np.int64)
        found = np.zeros(hashes.shape, dtype=np.uint16)
        for step in range(self.deepest):
            place = np.where(at > 0, np.minimum(at + step, len(self.hashes) - 1), 0)
            hit = (self.hashes[place] == hashes) & (place > 0)
            found[hit] = place[hit]
        return found


class Network:
    """Embeddings, filters of each width and the logistic unit over their largest responses."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 7):
        random = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        self.embeddings = random.normal(0, 0.1, (len(vocabulary.hashes), SIZE)).astype(np.float32)
        self.embeddings[0] = 0
        self.filters = [random.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.biases = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.out = random.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.shift = np.float32(0)

    def responses(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], dict]:
        """The largest response of each filter per text, and what training needs to know of how it came about.

        Every text is followed by enough zero vectors that no window reaches into the next; an empty text is one.
        """
        most = max(WIDTHS) - 1
        real = np.maximum(counts, 1)
        firsts = np.cumsum(real + most) - (real + most)
        starts = np.repeat(firsts - (np.cumsum(real) - real), real) + np.arange(real.sum())
        vectors = np.zeros((int((real + most).sum()), SIZE), dtype=np.float32)
        filled = np.repeat(counts > 0, real)
        vectors[starts[filled]] = self.embeddings[ids].sum(axis=1)
        bounds = np.cumsum(real) - real
        pooled, all_responses = [], []
        for filters, bias in zip(self.filters, self.biases):
            response = vectors[starts] @ filters[0]
            for step in range(1, len(filters)):
                response += vectors[starts + step] @ filters[step]
            response += bias
            pooled.append(np.maximum.reduceat(response, bounds, axis=0))
            all_responses.append(response)
        features = np.concatenate(pooled, axis=1)
        return np.maximum(features, 0), features, all_responses, {
            "vectors": vectors, "starts": starts, "bounds": bounds, "real": real, "filled": filled
        }

    def scores(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.zeros(0)
        features = self.responses(ids, counts)[0]
        return 1 / (1 + np.exp(-(features @ self.out + self.shift).astype(float)))

    def train(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adagrad on the logistic loss; the rarer label weighs more, by the root of its rarity. Gradients follow the largest responses only."""
        random = np.random.default_rng(seed)
        parameters = [self.embeddings, *self.filters, *self.biases, self.out]
        sums = [np.full(p.shape, 1e-6, dtype=np.float32) for p in parameters]
        shift_sum = 1e-6
        toxic = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        weights = np.where(labels > 0, np.sqrt((1 - toxic) / toxic), 1.0)
        for _ in range(epochs):
            order = random.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                chosen = order[at : at + BATCH]
                ids = np.concatenate([texts[k] for k in chosen])
                ids = np.where(random.random(ids.shape, dtype=np.float32) < DROPPED, 0, ids).astype(np.uint16)
                counts = np.array([len(texts[k]) for k in chosen])
                features, raw, responses, seen = self.responses(ids, counts)
                p = 1 / (1 + np.exp(-(features @ self.out + self.shift)))
                error = ((p - labels[chosen]) * weights[chosen] / len(chosen)).astype(np.float32)
                back = error[:, None] * self.out * (raw > 0)
                gradients = [np.zeros_like(x) for x in parameters]
                gradients[-1] = features.T @ error
                word_of = np.cumsum(seen["filled"]) - 1
                owner = np.repeat(np.arange(len(chosen)), seen["real"])
                for n, response in enumerate(responses):
                    own = slice(n * FILTERS, (n + 1) * FILTERS)
                    largest = response == raw[:, own][owner]
                    for f in range(FILTERS):
                        rows = np.flatnonzero(largest[:, f])
                        rows = rows[np.unique(owner[rows], return_index=True)[1]]
                        flow = back[:, n * FILTERS + f]
                        gradients[1 + len(WIDTHS) + n][f] += flow.sum()
                        for step in range(len(self.filters[n])):
                            gradients[1 + n][step][:, f] += flow @ seen["vectors"][seen["starts"][rows] + step]
                            # The word that stands there, if it belongs to the same text.
                            near = np.minimum(rows + step, len(owner) - 1)
                            inside = (rows + step < len(owner)) & (owner[near] == np.arange(len(chosen)))
                            inside &= seen["filled"][near]
                            move = flow[inside, None] * self.filters[n][step][:, f]
                            for column in range(ids.shape[1]):
                                np.add.at(gradients[0], ids[word_of[near[inside]], column], move)
                gradients[0][0] = 0
                for parameter, gradient, total in zip(parameters, gradients, sums):
                    total += gradient**2
                    parameter -= RATE * gradient / np.sqrt(total)
                shift_sum += float(error.sum()) ** 2
                self.shift = np.float32(self.shift - RATE * error.sum() / np.sqrt(shift_sum))


@released
def _hash_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "__text"):
            hashes, counts = word_hashes(part)
            bounds = np.concatenate(([0], np.cumsum(counts)))
            own = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            found = np.concatenate(own) if own else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["hash"])


def _id_batches(vocabulary):
    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                hashes, counts = word_hashes(part)
                ids = vocabulary.value.ids(hashes)
                bounds = np.concatenate(([0], np.cumsum(counts)))
                raw = pa.array([ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], type=pa.binary())
                names = ["__id", "label", "lang"]
                yield pa.RecordBatch.from_arrays([*map(part.column, names), raw, pa.array(counts)], [*names, "ids", "n"])

    return run


def _score_batches(network, names: list[str]):
    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = network.value
        for batch in batches:
            for part in slices(batch, "__text"):
                hashes, counts = word_hashes(part)
                scores = pa.array(own.scores(own.vocabulary.ids(hashes), counts))
                yield pa.RecordBatch.from_arrays([*map(part.column, names), scores], [*names, "score"])

    return run


def thresholds_of(counts: Iterable[tuple[str, int, int, int]]) -> dict[str | None, float]:
    """Per language the threshold that separates its labels best (by F1); None holds that of all rows.

    ``counts`` are language, label, number of ``CUTS`` that the score reaches, and rows. Languages with under
    ``LEAST_TOXIC`` toxic rows go by all rows, and those without any by ``THRESHOLD``.
    """
    found: dict[str | None, float] = {None: THRESHOLD}
    tables: dict[str | None, np.ndarray] = {None: np.zeros((2, len(CUTS) + 1))}
    for lang, label, step, n in counts:
        for own in (None, lang):
            tables.setdefault(own, np.zeros((2, len(CUTS) + 1)))[label, step] += n
    for lang, table in tables.items():
        if table[1].sum() < LEAST_TOXIC:
            continue
        hits, reached = (np.cumsum(x[::-1])[::-1][1:] for x in (table[1], table.sum(axis=0)))
        f1 = 2 * hits / np.maximum(table[1].sum() + reached, 1)
        best = np.flatnonzero(f1 >= f1.max() - 1e-12)
        found[lang] = float(CUTS[best[len(best) // 2]])
    return found


def best_thresholds(scores: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> dict[str | None, float]:
    """The thresholds of so many scores, as in ``thresholds_of``."""
    steps = np.searchsorted(CUTS, scores, side="right")
    return thresholds_of((lang or "", int(y), int(k), 1) for lang, y, k in zip(langs, labels, steps))


def calibrated(scored: DataFrame, labels: DataFrame, learnt: DataFrame, id: str) -> dict[str | None, float]:
    """The thresholds of all labelled rows that are not held out and whose ``__id`` is not among those ``learnt``.

    ``scored`` holds ``__id``, ``__lang``, ``__null`` (no text) and ``score``. One count for each language, label and cut
    returns to the driver.
    """
    own = labels.select(F.col(id).alias("__id"), F.col("toxic").cast("int").alias("label"))
    own = own.where(F.col("label").isin(0, 1) & ~held_out(F.col("__id")))
    steps = [(F.col("score") >= F.lit(float(c))).cast("int") for c in CUTS]
    step = steps[0]
    for more in steps[1:]:
        step = step + more
    rows = scored.where("NOT __null").join(own, "__id").join(learnt, "__id", "left_anti")
    counts = rows.groupBy(F.coalesce("__lang", F.lit("")).alias("lang"), "label", step.alias("step")).count()
    return thresholds_of(tuple(r) for r in counts.collect())


def train(
    docs: DataFrame, labels: DataFrame, id: str, text: str, lang: str, most: int, most_words: int
) -> tuple[Network, DataFrame | None]:
    """The network of a bounded sample, of which only the buckets of words reach the driver, and the ids learnt from.

    Without labels of both kinds there are no ids.
    """
    rows = training_rows(docs, labels, "toxic", most, id, text, extra={"lang": F.col(lang).cast("string")})
    rows = settle(rows)
    held = rows.mapInArrow(_hash_batches, "hash bigint").groupBy("hash").agg(F.count("*").alias("n"))
    common = held.where(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "hash").limit(MAX_EMBEDDINGS)
    vocabulary = Vocabulary(common.toArrow().column("hash").to_numpy().astype(np.int64).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = rows.schema["__id"].dataType.simpleString()
    coded = settle(rows.mapInArrow(_id_batches(shared), f"__id {kind}, label int, lang string, ids binary, n bigint"))
    place = F.row_number().over(Window.orderBy(F.xxhash64("__id"), "__id", "label", "n", "ids"))
    coded = coded.withColumn("place", place)
    sizes = coded.select("place", "n").toArrow().sort_by("place")
    # Rows that do not fit are left out, those after them are not.
    held, left_out = 0, []
    for at, n in zip(sizes.column("place").to_pylist(), sizes.column("n").to_pylist()):
        if held + n <= most_words:
            held += n
        else:
            left_out.append(at)
    found = coded.where(~F.col("place").isin(left_out)) if left_out else coded
    found = found.select("__id", "label", "ids", "place").toArrow().sort_by("place")
    y = found.column("label").to_numpy().astype(float)
    texts = [np.frombuffer(x, dtype=np.uint16).reshape(-1, 1 + len(BEGINNINGS)) for x in found.column("ids").to_pylist()]
    network = Network(vocabulary)
    if not len(y) or y.min() == y.max():
        network.out[:] = 0
        network.shift = np.float32(-5.0 if not len(y) or y.max() == 0 else 5.0)
        return network, None
    apart = np.arange(len(y)) % CALIBRATION == CALIBRATION - 1
    network.train([t for t, a in zip(texts, apart) if not a], y[~apart])
    ids = [(x,) for x, a in zip(found.column("__id").to_pylist(), apart) if not a]
    return network, settle(docs.sparkSession.createDataFrame(ids, f"__id {kind}").distinct())


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    most: int = MAX_TRAINING_ROWS,
    most_words: int = MAX_TRAINING_WORDS,
) -> DataFrame:
    """Per row: the id, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from 0.7) and ``flagged``.

    ``flagged`` goes by the threshold that all labelled rows outside training set for the row's language; the score rests on the text alone.
    Null texts count as empty and get a score like any other, null ids are held out, repeated rows get the same
    score. Without labels of both kinds all rows get the same score.
    """
    network, learnt = train(docs, labels, id, text, lang, most, most_words)
    rows = docs.select(
        F.col(id).alias("__id"),
        F.col(lang).cast("string").alias("__lang"),
        F.col(text).isNull().alias("__null"),
        whole_text(F.col(text)).alias("__text"),
    )
    kind = rows.schema["__id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(network)
    scored = settle(
        rows.mapInArrow(
            _score_batches(shared, ["__id", "__lang", "__null"]), f"__id {kind}, __lang string, __null boolean, score double"
        )
    )
    thresholds = {None: THRESHOLD} if learnt is None else calibrated(scored, labels, learnt, id)
    threshold = F.lit(thresholds[None])
    for name, value in thresholds.items():
        if name is not None:
            threshold = F.when(F.coalesce("__lang", F.lit("")) == name, F.lit(value)).otherwise(threshold)
    return scored.select(
        F.col("__id").alias(id),
        held_out(F.col("__id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        (F.col("score") >= threshold).alias("flagged"),
    )
