"""Spelling variants: the vocabulary acceptor composed with a one-edit transducer and with itself.

Two words are near if one inserted, deleted or replaced code point makes one the other. The pairs are the paths that the
composition of acceptor, transducer and acceptor accepts. It is enumerated apart for every initial state: a state that all
words with one beginning, or with one ending, share. An edit leaves the first half of the shorter word alone or the rest
of it, so every pair has such a state in common, and the initial states need not know each other. A state with very many
words is replaced by its successors (half of what is left at either end is fixed as well) until it is small. What is left
is at last a single code point, which bounds a state's words by the alphabet, whatever the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edulake.llm.textops import released, whole_text
from edulake.session import settle

#: Code points of a word, and its occurrences, at least.
LEAST_CHARS = 5
LEAST_COUNT = 3
#: One in so many occurrences, by the checksum of document and run, has a code point deleted.
NOISE = 97
#: Words of an initial state that are enumerated at once; states with more are split.
MOST_WORDS = 20_000
#: Words that a task sums up before it sends them on, and states of an acceptor before it starts a new one.
HELD = 1 << 18

_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_CHARS)
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")
_BLOCK = 1 << 20


def runs(text: str) -> Iterator[list[str]]:
    """The maximal runs of letters with at least ``LEAST_CHARS`` code points, in blocks that cut no run."""
    first = 0
    while first < len(text):
        gap = _OTHER.search(text, first + _BLOCK)
        last = gap.start() if gap else len(text)
        yield _RUN.findall(text, first, last)
        first = last


@released
def _word_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally: Counter[str] = Counter()

    def taken() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(tally.keys(), pa.string()), pa.array(tally.values(), pa.int64())], ["word", "n"]
        )
        tally.clear()
        return batch

    for batch in batches:
        texts = batch.column("__text").cast(pa.large_binary())
        for key, text in zip(batch.column("__id").to_pylist(), texts, strict=True):
            prefix = zlib.crc32(f"{key}:".encode())
            for block in runs(text.as_py().lower().decode()):
                for run, count in Counter(block).items():
                    mark = zlib.crc32(run.encode(), prefix)
                    if mark % NOISE == 0:
                        place = mark % len(run)
                        run = run[:place] + run[place + 1 :]
                        if len(run) < LEAST_CHARS:
                            continue
                    tally[run] += count
                if len(tally) >= HELD:
                    yield taken()
    yield taken()


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word`` and its occurrences ``n`` over whole texts, summed up inside every task before they are shuffled.

    A null text has no words; a null id stands in the checksum as the empty string.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(key.alias("__id"), whole_text(F.col(text)).alias("__text"))
    found = rows.mapInArrow(_word_batches, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Acceptor:
    """Minimised acyclic acceptors of many sorted word lists; equal states exist once over all lists.

    A state has its arcs by code point, each with the state it leads to and the number of words before that arc, and the
    number of words accepted from it. So a path gives the place of its word in the list, and no text is put together.
    """

    def __init__(self):
        self.register: dict[tuple, int] = {}
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.words: list[int] = []

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        signature = (final, *arcs)
        state = self.register.get(signature)
        if state is None:
            state = self.register[signature] = len(self.arcs)
            before, out = int(final), {}
            for letter, target in arcs:
                out[letter] = (target, before)
                before += self.words[target]
            self.arcs.append(out)
            self.final.append(final)
            self.words.append(before)
        return state

    def add(self, words: list[str]) -> int:
        """The initial state of a list of distinct words in code-point order."""
        path: list[tuple[bool, list]] = [(False, [])]
        last = ""

        def close(depth: int) -> None:
            for place in range(len(path) - 1, depth, -1):
                final, arcs = path.pop()
                path[-1][1].append((last[place - 1], self._state(final, arcs)))

        for word in words:
            same = 0
            for a, b in zip(last, word):  # noqa: B905
                if a != b:
                    break
                same += 1
            close(same)
            path.extend((False, []) for _ in range(len(word) - same))
            path[-1] = (True, path[-1][1])
            last = word
        close(0)
        return self._state(*path[0])

    def _common(self, p: int, i: int, q: int, j: int, without: str | None = None) -> Iterator[tuple[int, int]]:
        """Words that both states accept, as places in either list; the first code point is not ``without``."""
        stack = [(p, i, q, j, without)]
        while stack:
            p, i, q, j, without = stack.pop()
            if self.final[p] and self.final[q]:
                yield i, j
            ours, theirs = self.arcs[p], self.arcs[q]
            for letter, (target, before) in ours.items():
                other = theirs.get(letter)
                if other is not None and letter != without:
                    stack.append((target, i + before, other[0], j + other[1], None))

    def replaced(self, start: int) -> Iterator[tuple[int, int]]:
        """Pairs of words of one list that differ in one replaced code point, each once."""
        stack = [(start, 0)]
        while stack:
            p, i = stack.pop()
            arcs = list(self.arcs[p].values())
            for at, (first, before) in enumerate(arcs):
                stack.append((first, i + before))
                for second, behind in arcs[at + 1 :]:
                    yield from self._common(first, i + before, second, i + behind)

    def inserted(self, short: int, long: int, at_end: bool) -> Iterator[tuple[int, int]]:
        """Pairs of a word of ``short`` and one of ``long`` that has one code point more, each once.

        Among equal neighbours the last one counts as inserted. ``at_end``: also behind a whole word.
        """
        stack = [(short, 0, long, 0)]
        while stack:
            p, i, q, j = stack.pop()
            if at_end or not self.final[p]:
                for letter, (target, behind) in self.arcs[q].items():
                    yield from self._common(p, i, target, j + behind, letter)
            for letter, (target, before) in self.arcs[p].items():
                other = self.arcs[q].get(letter)
                if other is not None:
                    stack.append((target, i + before, other[0], j + other[1]))


def near_in_state(acceptor: Acceptor, group: list[tuple[str, int]], least: int, head: int, tail: int):
    """Near pairs of the words of an initial state, as places in ``group``; ``head`` and ``tail`` code points are fixed.

    ``least`` is the length of the shorter word. A pair that other fixed code points find as well is left to the state
    that fixes more at the beginning: with a fixed ending, that is a code point inserted right in front of it.
    """
    short = sorted((w[head : len(w) - tail], k) for k, (w, _) in enumerate(group) if len(w) == least)
    long = sorted((w[head : len(w) - tail], k) for k, (w, _) in enumerate(group) if len(w) != least)
    if not short:
        return
    first = acceptor.add([w for w, _ in short])
    for i, j in acceptor.replaced(first):
        yield short[i][1], short[j][1]
    if long:
        second = acceptor.add([w for w, _ in long])
        for i, j in acceptor.inserted(first, second, at_end=tail == 0):
            yield short[i][1], long[j][1]


_SUMMED = "word string, n_near bigint, form_n bigint, form string"


@released
def _state_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by initial state. Gives for every word of a state how many are near there and the commonest."""
    acceptor = Acceptor()
    out: list[tuple[str, int, int, str]] = []

    def finish(key: tuple, group: list[tuple[str, int]]) -> None:
        nonlocal acceptor
        if len(acceptor.arcs) > HELD:
            acceptor = Acceptor()
        near: dict[int, list] = {}
        for a, b in near_in_state(acceptor, group, *key[:3]):
            for own, other in ((a, b), (b, a)):
                word, n = group[other]
                seen = near.get(own)
                if seen is None:
                    near[own] = [1, n, word]
                else:
                    seen[0] += 1
                    if (n, seen[2]) > (seen[1], word):
                        seen[1:] = n, word
        out.extend((group[own][0], *found) for own, found in near.items())

    def taken() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n_near", "form_n", "form"]
        )
        out.clear()
        return batch

    before, group = None, []
    for batch in batches:
        names = ("least", "head", "tail", "word", "n")
        for least, head, tail, word, n in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            key = (least, head, tail, word[:head], word[len(word) - tail :])
            if key != before:
                if len(group) > 1:
                    finish(before, group)
                before, group = key, []
            group.append((word, n))
        if len(out) >= HELD:
            yield taken()
    if len(group) > 1:
        finish(before, group)
    yield taken()


_STATE = ["least", "head", "tail", "left", "right"]


def _in_states(rows: DataFrame, choices: Column) -> DataFrame:
    """One row per choice of fixed code points (structs of ``head`` and ``tail``)."""
    rows = rows.select("word", "n", "least", F.explode(choices).alias("__s")).select("word", "n", "least", "__s.*")
    size = F.char_length("word")
    return rows.withColumns(
        {
            "left": F.substring("word", F.lit(1), F.col("head")),
            "right": F.substring("word", size - F.col("tail") + 1, F.col("tail")),
        }
    )


def _choice(head: Column, tail: Column) -> Column:
    return F.struct(head.cast("int").alias("head"), tail.cast("int").alias("tail"))


def initial_states(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """Every word with the initial states that it passes: ``word``, ``n``, ``least``, ``head``, ``tail``, ``left``, ``right``.

    A word is the shorter one of pairs with ``least`` its own length, and the longer one with ``least`` one less. States
    without a pair to find are left out, states of more than ``most`` words are split; each round fixes half of the rest.
    """
    size = F.char_length("word")
    lengths = F.filter(F.array(size, size - 1), lambda x: x >= LEAST_CHARS)
    half = F.floor(F.col("least") / 2)
    rows = words.select("word", "n", F.explode(lengths).alias("least"))
    open_ = _in_states(rows, F.array(_choice(half, F.lit(0)), _choice(F.lit(0), F.col("least") - half)))
    found = None
    while True:
        sizes = open_.groupBy(*_STATE).agg(
            F.count("*").alias("__n"), F.count_if(F.char_length("word") == F.col("least")).alias("__short")
        )
        sizes = settle(sizes.where("__n > 1 AND __short > 0").drop("__short"))
        rest = F.col("least") - F.col("head") - F.col("tail")
        large = (F.col("__n") > most) & (rest > 1)
        rows = open_.join(sizes, _STATE)
        small = rows.where(~large).select("word", "n", *_STATE)
        found = small if found is None else found.unionByName(small)
        if sizes.where(large).isEmpty():
            return found
        step = F.floor(rest / 2)
        split = F.array(
            _choice(F.col("head") + step, F.col("tail")), _choice(F.col("head"), F.col("tail") + rest - step)
        )
        open_ = settle(_in_states(rows.where(large), split))


def near_words(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """For every word with a near word: their number ``n_near``, and the commonest, ``form`` with ``form_n``.

    ``words`` has distinct ``word`` and ``n``. Of equally common near words the smallest in code-point order counts.
    """
    states = initial_states(words, most).repartition(*_STATE).sortWithinPartitions(*_STATE)
    found = states.select("least", "head", "tail", "word", "n").mapInArrow(_state_batches, _SUMMED)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("__b"))
    return summed.select("word", "n_near", F.col("__b.form").alias("form"), (-F.col("__b.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for every row of ``word`` and ``form``: where following the forms ends.

    Every round doubles the steps that are followed. A form is at least twice as common as its word, so there are no
    circles, and a corpus of 2^60 words needs six rounds.
    """
    step = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        both = step.join(further, "root", "left")
        if both.where("__next IS NOT NULL").isEmpty():
            return step
        step = settle(both.select("word", F.coalesce("__next", "root").alias("root")))


def variants(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` for every row of distinct ``word`` and ``n``.

    The form is the commonest near word if that is at least twice as common as the word, else null; the root is where the
    forms end, the word itself if it has none. No words give no rows.
    """
    words = settle(words.select("word", "n"))
    near = near_words(words, most)
    joined = words.join(near, "word", "left")
    usual = F.col("form_n") >= 2 * F.col("n")
    joined = settle(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(usual, F.col("form")).alias("form"),
            F.when(usual, F.col("form_n")).alias("form_n"),
        )
    )
    ends = roots(joined.where("form IS NOT NULL"))
    return joined.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
