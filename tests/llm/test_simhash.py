from __future__ import annotations

import random
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from edulake import session
from edulake.llm import graph, simhash
from tests.llm import rules


def test_any_four_positions_hold_a_triple():
    triples = set(simhash.position_triples())
    assert len(triples) == 20
    for four in combinations(range(8), 4):
        assert any(t in triples for t in combinations(four, 3))


def test_fingerprints_and_components_match_brute_force(spark, edges):
    rows = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    prints = [rules.fingerprint(t) for _, t in rows]
    reach = rules.groups(prints)
    least = {}
    for (id, _), root in zip(rows, reach):
        if id is not None:
            least[root] = min(least.get(root, id), id)
    want = Counter((id, f"{p:016x}", least.get(root)) for (id, _), p, root in zip(rows, prints, reach))
    found = simhash.near_duplicates(edges).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == want


def test_blocks_of_a_crowded_key_lose_no_link(spark):
    choose = random.Random(5)
    # A crowd around one centre, chains, and strangers.
    centre = choose.getrandbits(64)
    prints = {centre}
    for _ in range(250):
        p = centre
        for bit in choose.sample(range(64), choose.randint(1, 6)):
            p ^= 1 << bit
        prints.add(p)
    prints |= {choose.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1, 15, 15 << 4 | 15}
    own = sorted(prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in own]
    table = spark.createDataFrame([(p,) for p in signed], "print bigint")
    for block in (16, 1024):
        edges = [(r.a, r.b) for r in simhash.links(table, block=block).collect()]
        place = {p: k for k, p in enumerate(signed)}
        parent = list(range(len(own)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            assert (own[place[a]] ^ own[place[b]]).bit_count() <= 4
            x, y = sorted((find(place[a]), find(place[b])))
            parent[y] = x
        assert [find(k) for k in range(len(own))] == rules.groups(own)


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3), (7, 7)]
    found = graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert {(r.node, r.component) for r in found} == {(k, 1) for k in range(1, 41)} | {(k, 100) for k in range(100, 160)}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_row_of_each_component_stays(spark, edges):
    rows = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    reach = rules.groups([rules.fingerprint(t) for _, t in rows])
    least = {}
    for (id, _), root in zip(rows, reach):
        least[root] = min(least.get(root, (True, 0)), (id is None, id or 0))
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(
        None if absent else id for absent, id in least.values()
    )


def test_empty_table(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.keep_one(nothing).count() == 0


def test_hash_is_that_of_the_engine(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("one two é")).alias("h")).first()
    assert row.h % (1 << 64) == simhash.shingle_hashes("One  TWO\né".encode())[0]


def changed(text: str, share: float, seed: int) -> str:
    """A copy of which about so great a share of the words is another one."""
    choose = random.Random(seed)
    return " ".join(f"w{choose.randrange(10**6)}" if choose.random() < share else w for w in text.split())


def test_similar_texts_are_found(spark):
    """Of pairs with a Jaccard similarity of 0.8 or more at five words nine in ten go, and unlike texts stay."""
    texts, pairs = {}, []
    for k in range(150):
        base = invented_words(k, 60 + 3 * k)
        texts[2 * k], texts[2 * k + 1] = base, changed(base, 0.005 + 0.09 * (k % 10) / 10, k)
        pairs.append((2 * k, 2 * k + 1))
    likeness = {p: rules.jaccard(*(rules.shingle_counts(texts[i]) for i in p)) for p in pairs}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    kept = {r.doc_id for r in simhash.keep_one_similar(docs).collect()}
    assert kept >= {a for a, _ in pairs}
    alike = [b for (_, b), j in likeness.items() if j >= 0.8]
    unlike = [b for (_, b), j in likeness.items() if j < 0.65]
    assert len(alike) > 40 and len(unlike) > 40
    assert sum(b not in kept for b in alike) >= 0.95 * len(alike)
    assert all(b in kept for b in unlike)


def invented_words(seed: int, n: int) -> str:
    choose = random.Random(seed)
    return " ".join(f"{choose.choice('abcdefgh')}{choose.randrange(4000)}" for _ in range(n))


def test_many_variants_of_one_text_leave_one(spark):
    base = invented_words(1, 300)
    rows = [(k, changed(base, 0.01, k)) for k in range(400)] + [(1000 + k, invented_words(50 + k, 100)) for k in range(30)]
    rows += [(2000, None), (2001, ""), (2002, "  "), (None, base), (1000, "another text"), (3000, "one two"), (3001, "One two")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted((r.doc_id, r.text) for r in simhash.keep_one_similar(docs).collect())
    assert [i for i, _ in got] == [0, 1000, 1000, *range(1001, 1030), 2000, 3000]
    assert simhash.keep_one_similar(docs.limit(0)).count() == 0


def test_steps_leave_no_files_behind(spark, monkeypatch):
    """Shuffle files go with the step that wrote them, and tables with the last step that reads them."""

    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
        return {b for b in blocks.split() if b.startswith("shuffle_")}

    monkeypatch.setattr(session, "_SETTLED", [])
    before, name = shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    docs = spark.createDataFrame([(k, invented_words(k // 2, 60)) for k in range(40)], "doc_id bigint, text string")
    kept = simhash.keep_one_similar(docs)
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.2)
    assert shuffled() <= before and spark.conf.get(name) == was
    columns = [spark.read.parquet(path).columns for path in session._SETTLED]
    assert not [c for c in columns if c in (["print", "wide"], ["print", "group"])]
    assert kept.count() == 20
    session.release_settled(spark)


def test_wide_bits_match_the_definition():
    hashes = [simhash.shingle_hashes(t.encode(), 5) for t in ("a b c d e f g", "x", "", "a b c d e f g " * 70)]
    counts = np.array([len(h) for h in hashes])
    flat = np.array([x for h in hashes for x in h], dtype=np.uint64)
    found = simhash.wide_bits(flat, counts, 3)
    for row, own in zip(found, hashes, strict=True):
        for lane in range(3):
            value = int.from_bytes(row[8 * lane : 8 * lane + 8].tobytes(), "little")
            with np.errstate(over="ignore"):
                mixed = simhash.mix(np.array(own, dtype=np.uint64) * simhash._lanes[lane]).tolist()
            assert value == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mixed) > len(own))


@pytest.mark.parametrize(("held", "block"), [(1 << 14, 1024), (4, 3)])
def test_all_entries_of_a_key_meet(spark, monkeypatch, held, block):
    """Two similar fingerprints meet under one key alone, behind others that are like neither."""
    choose = np.random.default_rng(5)
    wide = choose.integers(0, 256, (40, 128), dtype=np.uint8)
    wide[:12, :3] = 7
    wide[20:23, :3] = 9
    for a, b in ((8, 9), (9, 10), (20, 22)):
        wide[b, 6:] = wide[a, 6:]
        wide[b, 30:40] ^= 1
    monkeypatch.setattr(simhash, "triples_of", lambda positions, deals: np.array([[3, 4, 5], [0, 1, 2]]))
    classes = spark.createDataFrame([(k, bytearray(w.tobytes())) for k, w in enumerate(wide)], "print bigint, wide binary")
    found = simhash.similar_links(classes.repartition(3), deals=2, held=held, block=block).collect()
    joined = {}
    for r in found:
        a, b = sorted((r.a, r.b))
        joined[b] = joined.get(a, a)
    assert joined == {9: 8, 10: 8, 22: 20} or {frozenset((r.a, r.b)) for r in found} == {
        frozenset(x) for x in ((8, 9), (8, 10), (20, 22))
    }
