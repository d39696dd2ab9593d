from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edulake.llm import hard_negatives
from edulake.llm.queries import QUERIES

SCHEMA = "id bigint, label bigint, vector array<double>"


def plain(rows, every, positives=5, negatives=3, low=50, high=95):
    """All pairs of sound rows, one for each id."""
    one = {}
    for key, label, vector in rows:
        if key is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        one[key] = min(one.get(key, (label, vector)), (label, vector))
    out = set()
    for anchor, (label, query) in one.items():
        if anchor % every:
            continue
        score = {k: int(sum(a * b for a, b in zip(query, v))) for k, (_, v) in one.items() if k != anchor}  # noqa: B905
        ranked = sorted(score, key=lambda k: (-score[k], k))
        for p in [k for k in ranked if one[k][0] == label][:positives]:
            inside = [k for k in ranked if one[k][0] != label and low * score[p] <= 100 * score[k] <= high * score[p]]
            out |= {(anchor, p, r, k, score[p], score[k]) for r, k in enumerate(inside[:negatives], 1)}
    return out


def invented(seed, n, width=6, groups=5):
    """Clusters of different size, a third of all rows in one point, and equal scores."""
    choose = random.Random(seed)
    heart = [[choose.randint(-40, 40) for _ in range(width)] for _ in range(groups)]
    rows = []
    for k in range(n):
        near = heart[0] if k % 3 == 0 else [x + choose.randint(-6, 6) for x in choose.choice(heart)]
        rows.append((k, choose.randrange(3), [float(x) for x in near]))
    return rows


@pytest.mark.parametrize(("block", "centres"), [(40, 256), (64, 3), (10_000, 1)])
def test_agrees_with_all_pairs(spark, block, centres):
    rows = invented(block, 400)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hard_negatives.mine(table, F.col("id") % 20 == 0, block=block, most_centres=centres)
    got = list(map(tuple, got.collect()))
    assert len(set(got)) == len(got) and set(got) == plain(rows, 20)


def test_edge_rows(spark):
    nan, far = float("nan"), float("inf")
    rows = [(0, 1, [3.0, 4.0]), (1, 1, [3.0, 3.0]), (2, 2, [2.0, 2.0]), (3, 2, [2.0]), (4, 2, []), (5, 1, [0.0, 0.0])]
    rows += [(6, None, [9.0, 9.0]), (7, 1, None), (8, 2, [None, 1.0]), (9, 2, [nan, 1.0]), (10, 2, [far, 1.0])]
    rows += [(None, 2, [2.0, 2.0]), (2, 2, [2.0, 2.0]), (2, 3, [9.0, 9.0]), (20, 1, [-3.0, -4.0]), (40, 7, [1.0, 1.0])]
    names = ["row", "score", "centre", "rank", "low"]
    table = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA + "".join(f", {n} string" for n in names))
    got = hard_negatives.mine(table, F.col("id") % 20 == 0)
    assert set(map(tuple, got.collect())) == plain(rows, 20)


def test_all_rows_alike_and_no_rows(spark):
    rows = [(k, k % 2, [5.0, 0.0]) for k in range(300)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = hard_negatives.mine(table, F.col("id") % 20 == 0, low=100, high=100, block=50)
    assert set(map(tuple, got.collect())) == plain(rows, 20, low=100, high=100)
    assert hard_negatives.mine(table.limit(0), F.col("id") % 20 == 0).count() == 0


def test_tree_covers_and_separates():
    points = np.random.default_rng(3).normal(size=(500, 4)).round(2)
    tree = hard_negatives.Tree.grow(points, np.arange(500), np.arange(500) % 4, 1e4)
    whole = hard_negatives.augment(tree.vectors, 1e4)
    assert sorted(tree.ids.tolist()) == list(range(500))
    for k in range(len(tree.lo)):
        inside = whole[tree.lo[k] : tree.hi[k]]
        assert np.linalg.norm(inside - inside[0], axis=1).max() <= tree.radius[k] + 1e-9
        own = range(tree.child[k], tree.child[k] + tree.kids[k])
        assert not own or (tree.lo[own[0]], tree.hi[own[-1]]) == (tree.lo[k], tree.hi[k])
        for a in own:
            assert tree.radius[a] <= tree.radius[k] / 2 + 1e-9
            for b in range(own[0], a):
                assert np.linalg.norm(whole[tree.lo[a]] - whole[tree.lo[b]]) > tree.radius[k] / 2


def test_search_skips_nodes_outside_the_window():
    rows = invented(1, 3000, groups=30)
    vectors = np.array([v for _, _, v in rows])
    tree = hard_negatives.Tree.grow(vectors, np.arange(3000), np.array([c for _, c, _ in rows]), 1e5)
    search = hard_negatives.Search(tree, 0, 0, vectors[0])
    scores, ids = search.best(3, 2000, 3000, same=False)
    plainly = sorted(((s, -k) for k, s in enumerate(vectors @ vectors[0]) if 2000 <= s <= 3000 and rows[k][1]), reverse=True)
    assert list(zip(scores, -ids, strict=True)) == plainly[:3]
    assert len(search.known) < (tree.kids > 0).sum() / 2


def test_query_agrees_with_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = []
    for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect():
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, [float(math.floor(256 * x)) for x in r.embedding]))
    got = QUERIES["op13_hard_negatives"](spark, folder)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert set(map(tuple, got.select(names).collect())) == plain(rows, 50)
