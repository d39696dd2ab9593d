"""The models: language-model scores, perplexity, quality and toxicity."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from edulake import session
from edulake.llm import boosting, ctw, grams, perplexity, toxicity
from edulake.llm.textops import Words, slices
from tests.llm import rules
from tests.llm.conftest import SCHEMA, edge_rows, invented


def batch(texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(texts, type=pa.string())], ["text"])


def test_words_and_hashes_stand_for_words():
    texts = [r[1] or "" for r in edge_rows()]
    seen: dict[int, str] = {}
    for most in (64, 1 << 20):
        counts = []
        for part in slices(batch(texts), most=most):
            words = Words(part, part.data)
            counts += words.counts.tolist()
            for h, s, e in zip(words.hashes().tolist(), words.starts, words.ends):
                assert seen.setdefault(h, (own := part.data[s:e].tobytes())) == own
        assert counts == [len(rules.words(t)) for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_grams_are_counted_over_whole_texts():
    texts = ["abcab", "", "é", "abc"]
    for most in (1, 1 << 20):
        found = Counter()
        for part in slices(batch(texts), most=most):
            keys, counts = grams.gram_keys(part, part.data, 3, end=True)
            assert counts.tolist() == [len(part.text_bytes(r)) + 1 for r in range(part.rows)]
            found.update(keys.tolist())
        want = Counter()
        for t in texts:
            own = b"\xff\xff" + t.encode() + b"\xff"
            want.update(int.from_bytes(own[i : i + 3], "big") for i in range(len(own) - 2))
        assert found == want


def test_tally_hands_on_all_it_was_given():
    choose, total, given = np.random.default_rng(1), Counter(), Counter()
    tally = grams.Tally(held=50)
    for _ in range(40):
        keys = choose.integers(0, 400, 60).astype(np.uint64)
        given.update(keys.tolist())
        for full in (tally.add(keys),):
            if full is not None:
                total.update(dict(zip(full[0].tolist(), full[1].tolist())))
    keys, counts = tally.take()
    total.update(dict(zip(keys.tolist(), counts.tolist())))
    assert total == given


def _kt(zeros: float, ones: float) -> float:
    return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.log(math.pi) - math.lgamma(zeros + ones + 1)


def _brute_tree(texts: list[bytes], depth: int):
    """Log weighted probability of the bits of all texts below a context, for one prefix of a byte's bits."""
    counts: dict[tuple, Counter] = {}
    for t in texts:
        own = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(own)):
            for d in range(depth + 1):
                for bit in range(8):
                    prefix = (bit, own[i] >> (8 - bit))
                    key = own[i - d : i], prefix
                    counts.setdefault(key, Counter())[own[i] >> (7 - bit) & 1] += 1

    def weighted(context: bytes, prefix, extra=None, path=b"") -> float:
        """With ``extra`` one more bit whose context is ``path``."""
        c = Counter(counts.get((context, prefix), ()))
        here = extra is not None and path.endswith(context)
        if here:
            c[extra] += 1
        own = _kt(c[0], c[1])
        if len(context) == depth:
            return own
        below = [k[0] for k in counts if k[1] == prefix and len(k[0]) == len(context) + 1 and k[0].endswith(context)]
        if here and path[-len(context) - 1 :] not in below:
            below.append(path[-len(context) - 1 :])
        rest = sum(weighted(b, prefix, extra, path) for b in below)
        return np.logaddexp(math.log(0.5) + own, math.log(0.5) + rest)

    return weighted


def test_tree_is_the_weighted_mixture_of_all_depths(spark):
    texts = ["abab ab", "abba", "ba aab", "abab"]
    rows = spark.createDataFrame([(t,) for t in texts], "__text string")
    tree = ctw.fit(ctw.corpus_counts(rows, 2), 2, 10_000)
    weighted = _brute_tree([t.encode() for t in texts], 2)
    sums = np.power(10.0, tree.log10.astype(float)).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-4)
    for text in ("abab", "b"):
        own = b"\xff\xff" + text.encode() + b"\xff"
        want = 0.0
        for i in range(2, len(own)):
            for bit in range(8):
                prefix, value = (bit, own[i] >> (8 - bit)), own[i] >> (7 - bit) & 1
                want += weighted(b"", prefix, value, own[i - 2 : i]) - weighted(b"", prefix)
        part = next(slices(batch([text])))
        assert tree.scores(ctw.token_text(part)[0])[0] == pytest.approx(want / math.log(10), rel=1e-3)


def test_rare_contexts_are_one_child(spark):
    texts = [invented(k, 200) for k in range(6)]
    counts = ctw.corpus_counts(spark.createDataFrame([(t,) for t in texts], "__text string"), 3)
    few, many = ctw.fit(counts, 3, 30), ctw.fit(counts, 3, 2000)
    assert len(few.log10) <= 30 < len(many.log10) <= 2000
    assert np.allclose(np.power(10.0, few.log10.astype(float)).sum(axis=1), 1, atol=1e-4)
    part = next(slices(batch([invented(50, 200)])))
    own = ctw.token_text(part)[0]
    assert many.scores(own)[0] > few.scores(own)[0]


@pytest.mark.parametrize("most", [4, 1 << 21])
def test_scores_are_those_of_all_contexts(spark, monkeypatch, most):
    """No context is left out, however many there are, and no n-gram, however few are sent along."""
    monkeypatch.setattr(ctw, "MAX_CONTEXTS", 2)
    texts = {k: " ".join("ab"[(k * k + j * k) % 3 % 2] * (1 + (j + k) % 3) for j in range(5)) for k in range(24)}
    held = {k for k in texts if rules.fold(k, 10) == 0}
    assert held and len(held) < len(texts)
    weighted = _brute_tree([t.encode() for k, t in texts.items() if k not in held], 3)
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts.items()], SCHEMA).repartition(3)
    scored = {r.doc_id: r.score for r in ctw.score(docs, depth=3, max_grams=most).collect()}
    for k in [*sorted(held), *range(5)]:
        own = b"\xff\xff\xff" + texts[k].encode() + b"\xff"
        want = 0.0
        for i in range(3, len(own)):
            for bit in range(8):
                prefix, value = (bit, own[i] >> (8 - bit)), own[i] >> (7 - bit) & 1
                want += weighted(b"", prefix, value, own[i - 3 : i]) - weighted(b"", prefix)
        assert scored[k] == pytest.approx(want / math.log(10), rel=1e-6)


def test_scores_match_brute_force(spark, edges):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    tokens = [[*rules.words(rules.lower(t)), None] for _, t in rows]
    held = [id is None or rules.fold(id, 10) == 0 for id, _ in rows]
    counts = Counter(w for own, h in zip(tokens, held) if not h for w in own)
    n, v = sum(counts.values()), len(counts)
    for frequent in (3, 1 << 16):
        found = ctw.score(edges, max_frequent=frequent).collect()
        key = lambda id, k: (id is None, id or 0, k)
        got = sorted(found, key=lambda r: key(r.doc_id, r.n_tokens))
        want = sorted(zip(rows, tokens, held), key=lambda x: key(x[0][0], len(x[1])))
        for r, ((id, _), own, out) in zip(got, want, strict=True):
            base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
            known = sum(counts[w] > 0 for w in own)
            assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (id, out, len(own), known, n)
            assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_scores_of_nothing(spark, nothing):
    assert ctw.score(nothing).count() == 0
    held = next(k for k in range(100) if rules.fold(k, 10) == 0)
    row = ctw.score(spark.createDataFrame([(held, "a b", "en", "s", 1)], SCHEMA)).first()
    assert (row.n_known, row.train_tokens) == (0, 0)
    assert row.score == pytest.approx(-4 * 8 * math.log10(2), rel=1e-3)


def test_measures_match_brute_force():
    texts = [r[1] or "" for r in edge_rows()] + ["a b c a b c\n\na\n a\na\na\r", "x\n\n\nx", "#|#\n#|#", "é ê é ê é"]
    for most in (50, 1 << 20):
        found = [tuple(row) for p in slices(batch(texts), most=most) for row in zip(*map(list, perplexity.measures(p)))]
        assert found == [rules.measures(t) for t in texts]


def test_kneser_ney_sums_to_one(spark):
    texts = [invented(k, 300) for k in range(8)]
    rows = spark.createDataFrame([(t, "x") for t in texts], "__text string, language string")
    for most in (60, 1 << 20):
        model = perplexity.fit(rows, 3, most)["x"]
        assert max(map(len, model.keys)) <= most
        for context in (b"an", b"\xff\xff", b"zz", b" \x00", b"n "):
            keys = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], dtype=np.uint64)
            total = np.exp(model.log_probabilities(keys)).sum()
            assert 0.97 < total < 1.03, (context, total)


def test_kneser_ney_matches_the_formula(spark):
    texts = [invented(k, 300) for k in range(8)]
    table = spark.createDataFrame([(t, "x") for t in texts], "__text string, language string")
    model = perplexity.fit(table, 2)["x"]
    pairs = Counter()
    for t in texts:
        own = b"\xff" + t.encode()
        pairs.update(zip(own, own[1:]))
    before = Counter(b for _, b in pairs)

    def discount(counts: Counter, c: int) -> float:
        n = Counter(min(x, 5) for x in counts.values())
        if min(n[1], n[2], n[3], n[4]) < 1:
            return 0.5
        y = n[1] / (n[1] + 2 * n[2])
        k = min(c, 3)
        return min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k)

    def lower(b: int) -> float:
        total = sum(before.values())
        left = sum(discount(before, c) for c in before.values()) / total
        c = before[b]
        return (max(c - discount(before, c), 0) / total if c else 0) + max(left, 1e-6) / 257

    for a, b in list(pairs)[:60]:
        total = sum(c for (x, _), c in pairs.items() if x == a)
        left = sum(discount(pairs, c) for (x, _), c in pairs.items() if x == a) / total
        want = max(pairs[a, b] - discount(pairs, pairs[a, b]), 0) / total + left * lower(b)
        found = model.log_probabilities(np.array([a << 8 | b], dtype=np.uint64))[0]
        assert found == pytest.approx(math.log(want), rel=1e-3), (a, b)


@pytest.mark.parametrize("most", [3, 1 << 19])
def test_perplexity_rests_on_all_grams(spark, most):
    """However little room there is, the logs are those of models that hold every n-gram."""
    texts = [(invented(k, 80 + k), "en" if k % 3 else "fr") for k in range(20)] + [("$ % | " * 60, "de"), (None, "en")]
    docs = spark.createDataFrame([(k, *row) for k, row in enumerate(texts)], "doc_id bigint, text string, lang string")
    whole = docs.select(F.coalesce("text", F.lit("")).alias("__text"), F.col("lang").alias("language"))
    models = perplexity.fit(whole, max_grams=1 << 24)
    judged = {r.doc_id: r.log_perplexity for r in perplexity.judge(docs, keep=["doc_id"], max_grams=most).collect()}
    for k, (text, lang) in enumerate(texts):
        if not text:
            assert judged[k] is None
            continue
        keys = grams.gram_keys(*(lambda p: (p, p.data))(next(slices(batch([text])))), perplexity.ORDER, end=False)[0]
        model = models.get(lang, perplexity.empty_model())
        assert judged[k] == pytest.approx(-model.log_probabilities(keys).mean(), rel=1e-6)


def test_frequent_grams_meet_no_join(spark, monkeypatch):
    """N-grams are sent by how often all texts hold them, and what no result rests on is not kept."""
    monkeypatch.setattr(session, "_SETTLED", [])
    texts = [(invented(k, 80), "en") for k in range(20)] + [("$ % | " * 60, "en"), ("# & < " * 9, "de"), (None, "fr")]
    docs = spark.createDataFrame([(k, *row) for k, row in enumerate(texts)], "doc_id bigint, text string, lang string")
    size = sum(len((t or "").encode()) for t, _ in texts)
    joined = []
    for most in (1 << 19, 300, 0):
        assert perplexity.judge(docs, keep=["doc_id"], max_grams=most).count() == len(texts)
        tables = [spark.read.parquet(path) for path in session._SETTLED]
        assert sorted("__rare" in t.columns for t in tables) == [False, True]
        scored = next(t for t in tables if "__rare" in t.columns)
        joined.append(scored.agg(F.sum(F.size("__rare"))).first()[0])
        session.release_settled(spark)
    assert joined[0] == 0 < joined[1] < joined[2] == size


def test_most_seen_grams(spark):
    seen = [1, 1, 1, 2, 2, 7, 7, 7, 9, 1000]
    table = spark.createDataFrame(list(enumerate(seen)), "key bigint, seen bigint")
    for most, want in ((0, []), (1, [1000]), (2, [9, 1000]), (4, [9, 1000]), (5, seen[5:]), (9, seen[3:]), (10, seen)):
        assert sorted(r.seen for r in perplexity.most_seen(table, most).collect()) == want


def test_judgement(spark, edges, nothing):
    plain = [(200 + k, invented(900 + k, 120), "en", "s", 1) for k in range(40)]
    odd = [(300, "".join(chr(33 + (k * 7919) % 90) + " " * (k % 5 == 0) for k in range(900)), "en", "s", 1)]
    docs = edges.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(plain + odd, SCHEMA))
    judged = perplexity.judge(docs, keep=["doc_id", "text"]).collect()
    assert Counter(r.doc_id for r in judged) == Counter(r.doc_id for r in docs.collect())
    for r in judged:
        n, chars, symbols, dup, repeated = rules.measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (r.base_failed and r.kept)
        if r.doc_id is not None and 200 <= r.doc_id < 300:
            assert r.kept
    assert not [r for r in judged if r.doc_id == 300][0].kept
    assert perplexity.judge(edges).select("row.*").columns == edges.columns
    assert perplexity.judge(nothing).count() == 0


def test_whole_rows_are_not_settled_again(spark, edges, monkeypatch):
    """What stays of a judgement is a verdict for each text and language, and every row gets that of its own."""
    monkeypatch.setattr(session, "_SETTLED", [])
    more = [(200 + k, invented(900 + k, 120), "en", "s", 1) for k in range(40)]
    docs = edges.select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        spark.createDataFrame(more, edges.select("doc_id", "text", "lang", "source", "n_chars").schema)
    )
    judged = perplexity.judge(docs)
    measured = [c for c in judged.columns if c != "row"]
    tables = [spark.read.parquet(path) for path in session._SETTLED]
    found = judged.select("row.*", *measured).collect()
    assert [("row" in t.columns, t.count()) for t in tables] == [(False, len({(r.text or "", r.lang or "") for r in found}))]
    session.release_settled(spark)
    plain = perplexity.judge(docs, keep=docs.columns).select(*docs.columns, *measured).collect()

    def counted(rows):
        return Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)

    assert counted(found) == counted(plain) and len({r.kept for r in found}) == 2


def test_rare_languages_keep_their_grams(spark):
    """One language has a thousandth of the bytes; its model is that of its own texts alone."""
    common = [(invented(k % 40, 400), "en") for k in range(800)]
    rare = [("zwölf żółw gęś jaźń " * 3 + invented(7, 70).translate(str.maketrans("aeiou", "óęąźż")), "pl")]
    schema = "__text string, language string"
    both = perplexity.fit(spark.createDataFrame(common + rare, schema), 4, 4000)
    alone = perplexity.fit(spark.createDataFrame(rare, schema), 4, 2000)
    assert set(both) == {"en", "pl"} and sum(len(t) for t, _ in rare) < 0.003 * sum(len(t) for t, _ in common)
    for k in range(4):
        assert np.array_equal(both["pl"].keys[k], alone["pl"].keys[k]) and len(both["pl"].keys[k])
        assert np.allclose(both["pl"].logs[k], alone["pl"].logs[k])
        assert len(both["en"].keys[k]) + len(both["pl"].keys[k]) <= 4000


def test_bands_and_verdict_match_brute_force(spark):
    """The limits follow each language's own quantiles, and texts beyond either one go."""
    choose = random.Random(11)
    usual = [invented(k, 150) for k in range(200)]
    syllables = "an on er in th".split()
    too_plain = " ".join("er" * choose.randint(1, 40) for _ in range(200))
    # Its many signs keep it from teaching the model.
    too_odd = " ".join("".join(choose.choices("#$%&*|<>qwxyzkj0123", k=6)) for _ in range(120))
    rows = [(k, t, "en") for k, t in enumerate(usual)] + [(900, too_plain, "en"), (901, too_odd, "en")]
    rows += [(500 + k, " ".join("".join(choose.choices(syllables, k=2)) for _ in range(90)), "de") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    judged = {r.doc_id: r for r in perplexity.judge(docs, keep=["doc_id", "lang"]).collect()}
    for lang in ("en", "de"):
        own = [r for r in judged.values() if r.lang == lang and not r.base_failed]
        bins = [math.floor(r.log_perplexity / 0.002) for r in own]
        low, middle, high = ((np.percentile(bins, q) + 0.5) * 0.002 for q in (25, 50, 75))
        lower = middle - max(perplexity.LEAST_WIDTH, perplexity.LOWER_WIDTH * (middle - low))
        upper = middle + max(perplexity.LEAST_WIDTH, perplexity.UPPER_WIDTH * (high - middle))
        for r in own:
            assert (r.lower, r.upper) == (pytest.approx(lower), pytest.approx(upper))
            assert r.kept == (lower <= r.log_perplexity <= upper)
    assert not judged[900].base_failed and not judged[900].kept and judged[900].log_perplexity < judged[900].lower
    assert not judged[901].base_failed and not judged[901].kept and judged[901].log_perplexity > judged[901].upper
    assert sum(judged[k].kept for k in range(200)) >= 198


def test_flat_forest_equals_walking_each_tree():
    choose = np.random.default_rng(2)
    x = choose.normal(size=(1200, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] + x[:, 2] > 0.5)).astype(float)
    forest = boosting.fit(x[:800], y[:800])
    assert ((forest.scores(x[800:]) > 0.5) == y[800:]).mean() > 0.9
    for row in x[:20]:
        total = forest.start
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            while node < len(threshold):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(threshold)]
        assert forest.margins(row[None])[0] == pytest.approx(total)


def _accuracy(spark, found, label):
    from tests.llm.conftest import FOLDER

    marks = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", label).where(f"{label} IS NOT NULL")
    rows = found.where("held_out").join(marks, "doc_id").collect()
    return sum(r.predicted == r[label] for r in rows) / len(rows)


def test_quality_classifier(spark, documents, edges, labels, nothing):
    from tests.llm.conftest import FOLDER

    found = boosting.classify(documents, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert _accuracy(spark, found, "quality") > 0.9
    rows = boosting.classify(edges, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in edges.collect())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is None or rules.fold(r.doc_id, 3) == 1) for r in rows)
    assert boosting.classify(nothing, labels).count() == 0
    assert {r.score for r in boosting.classify(edges, labels.limit(0)).collect()} == {0.5}


def test_labels_of_held_out_rows_teach_nothing(spark, edges, labels):
    from pyspark.sql import functions as F

    from edulake.llm.labels import held_out

    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda own: sorted((r.doc_id or 0, r.score) for r in boosting.classify(edges, own).collect())
    assert score(labels) == score(flipped)


def test_network_finds_marked_words():
    choose = random.Random(4)
    texts = [" ".join(f"w{choose.randint(0, 60)}" for _ in range(40)) for _ in range(400)]
    y = np.array([k % 4 == 0 for k in range(400)], dtype=float)
    texts = [t.replace("w7 ", "vile ") + " vilest end" if m else t for t, m in zip(texts, y)]
    hashes, counts = toxicity.word_hashes(next(slices(batch(texts), most=1 << 30)))
    known, n = np.unique(hashes, return_counts=True)
    vocabulary = toxicity.Vocabulary(known[n >= 4])
    ids = vocabulary.ids(hashes)
    places = {int(h): k for k, h in enumerate(vocabulary.hashes) if k}
    assert all(places.get(int(h), 0) == int(i) for h, i in zip(hashes.ravel()[:4000], ids.ravel()[:4000]))
    own = np.split(ids, np.cumsum(counts)[:-1])
    network = toxicity.Network(vocabulary)
    network.train(own[:300], y[:300])
    scores = network.scores(np.concatenate(own[300:]), counts[300:])
    assert ((scores >= 0.7) == (y[300:] > 0)).all()


def test_largest_responses_match_a_plain_convolution():
    choose = np.random.default_rng(5)
    network = toxicity.Network(toxicity.Vocabulary(choose.integers(1, 1 << 62, 50).astype(np.uint64)))
    texts = [choose.integers(0, 51, (n, 4)).astype(np.uint16) for n in (0, 1, 2, 9, 0)]
    _, raw, _, _ = network.responses(np.concatenate(texts), np.array(list(map(len, texts))))
    for own, found in zip(texts, raw):
        vectors = network.embeddings[own].sum(axis=1) if len(own) else np.zeros((1, toxicity.SIZE))
        padded = np.concatenate((vectors, np.zeros((2, toxicity.SIZE))))
        want = []
        for filters, bias in zip(network.filters, network.biases):
            seen = [
                sum(padded[t + k] @ filters[k] for k in range(len(filters))) + bias for t in range(len(vectors))
            ]
            want.append(np.max(seen, axis=0))
        assert np.allclose(np.concatenate(want), found, atol=1e-5)


def test_thresholds_by_language():
    y = np.array([0, 1] * 40, dtype=float)
    scores = np.where(y > 0, 0.6, 0.2)
    scores[40:] = np.where(y[40:] > 0, 0.9, 0.7)
    found = toxicity.best_thresholds(scores, y, ["en"] * 40 + ["fr"] * 40)
    assert 0.2 < found["en"] <= 0.6 and 0.7 < found["fr"] <= 0.9
    assert toxicity.best_thresholds(scores[:4], y[:4], [None] * 4) == {None: 0.7}


def test_thresholds_count_all_labelled_rows(spark, monkeypatch):
    """All labelled rows that the network has not seen are counted, however small the sample that it learns from."""
    rows = [(k, f"bad word {k}" if k % 2 else f"good word {k}", "en", "s", 1) for k in range(300)] + [(300, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([(k, 1, k % 2) for k in range(301)], "doc_id bigint, quality int, toxic int")
    seen, counted = [], []
    monkeypatch.setattr(toxicity.Network, "train", lambda self, texts, y: seen.extend(texts))
    monkeypatch.setattr(toxicity, "thresholds_of", lambda counts: counted.extend(counts) or {None: 0.7})
    toxicity.classify(docs, marks, most=20).collect()
    folds = sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in range(300))
    assert len(seen) == 16 and sum(n for *_, n in counted) == folds - 16


def test_long_rows_do_not_end_the_training_sample(spark, monkeypatch):
    rows = [(k, ("long word " * 500) if k % 4 == 0 else f"bad word {k}" if k % 2 else f"good word {k}") for k in range(80)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], SCHEMA)
    marks = spark.createDataFrame([(k, 1, k % 2) for k, _ in rows], "doc_id bigint, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity.Network, "train", lambda self, texts, y: seen.extend(map(len, texts)))
    toxicity.train(docs, marks, "doc_id", "text", "lang", 1000, 600)
    short = sum(zlib.crc32(str(k).encode()) % 3 != 1 for k, _ in rows if k % 4)
    # One row in five calibrates.
    assert len(seen) == short - short // toxicity.CALIBRATION and max(seen) == 3


def test_toxicity_classifier(spark, edges, labels, nothing):
    rows = toxicity.classify(edges, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in edges.collect())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 31}) == 1
    assert toxicity.classify(nothing, labels).count() == 0
    assert len({r.score for r in toxicity.classify(edges, labels.limit(0)).collect()}) == 1


def test_toxicity_of_held_out_rows(spark):
    """Rows that the model never learns from, of a table with enough labelled ones: nearly all are told apart."""
    folder = "/root/testdata/sf0.1"
    docs, marks = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    scored = toxicity.classify(docs, marks).where("held_out").join(marks, "doc_id").select("toxic", "predicted").collect()
    assert len(scored) > 1000
    right = sum(r.toxic == r.predicted for r in scored)
    assert right >= 0.95 * len(scored)
    assert right > sum(r.toxic == 0 for r in scored)
