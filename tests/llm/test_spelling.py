from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from edulake.llm import spelling
from edulake.llm.queries import QUERIES


def plain_words(rows) -> Counter:
    words: Counter = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            mark = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if mark % 97 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            words[run] += 1
    return Counter({w: n for w, n in words.items() if len(w) >= 5 and n >= 3})


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words: dict[str, int]) -> dict[str, tuple]:
    near = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[word] = best if best is not None and words[best] >= 2 * words[word] else None

    def root(word):
        return word if form[word] is None else root(form[word])

    return {w: (words[w], len(near[w]), form[w], words.get(form[w]), root(w)) for w in words}


def found(rows) -> dict[str, tuple]:
    rows = rows.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


@pytest.mark.parametrize("most", [2, 7, 20_000])
def test_variants_agree_with_all_pairs(spark, most):
    choose = random.Random(most)
    words = {"".join(choose.choices("abé", k=choose.randint(5, 8))): choose.randint(3, 60) for _ in range(400)}
    words |= {"a" * k: k for k in range(5, 12)}
    words |= {f"{'x' * 30}{a}{b}{'y' * 30}": 3 for a, b in itertools.product("abcdefgh", repeat=2)}
    words |= {"z" * 3000: 9, "z" * 3001: 3, "z" * 1500 + "q" + "z" * 1500: 4}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)
    assert found(spelling.variants(table, most)) == plain_variants(words)


def test_split_states_hold_no_more_than_asked(spark):
    words = [("x" * 9 + a + b + c + "y" * 9, 3) for a, b, c in itertools.product("abcdefghij", repeat=3)]
    states = spelling.initial_states(spark.createDataFrame(words, "word string, n bigint"), 50)
    assert states.groupBy("least", "head", "tail", "left", "right").count().agg({"count": "max"}).first()[0] <= 50


def test_acceptor_is_minimal():
    acceptor = spelling.Acceptor()
    acceptor.add(sorted(["tapes", "taped", "tops", "toped", "tape"]))
    signatures = [(f, tuple((c, t) for c, (t, _) in a.items())) for f, a in zip(acceptor.final, acceptor.arcs, strict=True)]
    assert len(set(signatures)) == len(signatures)


def test_words_of_edge_rows(spark, edges):
    got = {r.word: r.n for r in spelling.vocabulary(edges).collect()}
    assert got == plain_words([(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()])


def test_letters_marks_and_long_texts(spark):
    text = "×÷abÀ Àéïou KKelvin straße, HELLO hello_hello " * 3
    rows = [(1, text), (2, "word" * 400_000 + " " + "longer words here " * 70_000), (3, None), (4, "")]
    got = spelling.vocabulary(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.word: r.n for r in got.collect()} == plain_words(rows)


def test_noise_takes_a_letter_away():
    assert plain_words([(k, "letters") for k in range(2000)]).keys() > {"letters"}


def test_nothing_gives_nothing(spark, nothing):
    assert spelling.variants(spelling.vocabulary(nothing)).count() == 0


def test_query_agrees_with_brute_force(spark, documents):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    table = QUERIES["op11_spelling_variants"](spark, folder)
    assert dict(table.dtypes) == {
        "word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"
    }
    words = plain_words(rows)
    assert found(table) == plain_variants(words)
