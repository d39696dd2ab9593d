from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from edulake.functions.permutation import Permutation
from edulake.operators import sampling

SIZES = sorted({max(0, 2**k + d) for k in range(11) for d in (-1, 0, 1)} | {9, 10, 99, 100, 101, 720})


@pytest.mark.parametrize("n", SIZES)
def test_is_a_bijection_and_its_own_way_back(n):
    own = Permutation(n, "7")
    places = [own.place(k) for k in range(n)]
    assert sorted(places) == list(range(n))
    assert [own.number(p) for p in places] == list(range(n))
    assert own.a * own.b - n <= own.a


def test_columns_agree_with_numbers(spark):
    for n in (1, 5, 63, 64, 65, 1000, 4099):
        own = Permutation(n, "x")
        rows = spark.range(n).select("id", own.place_column(F.col("id")).alias("p"), own.number_column(F.col("id")).alias("q"))
        got = {r.id: (r.p, r.q) for r in rows.collect()}
        assert got == {k: (own.place(k), own.number(k)) for k in range(n)}


def test_large_numbers_come_back(spark):
    own = Permutation(10**11 + 7, "x")
    rows = spark.createDataFrame([(0,), (1,), (10**11,), (10**11 + 6,), (5 * 10**10,)], "id bigint")
    for r in rows.select("id", own.place_column(F.col("id")).alias("p")).collect():
        assert r.p == own.place(r.id) and 0 <= r.p < own.n and own.number(r.p) == r.id


def test_orders_differ_by_epoch_and_look_random(spark):
    numbered = sampling.number_rows(spark.range(2000), "id")
    first, second = (
        {r.id: r.position for r in sampling.epoch_order(numbered, "id", epoch=e).collect()} for e in (0, 1)
    )
    assert sorted(first.values()) == list(range(1, 2001)) and first != second
    pairs = [(first[k], second[k]) for k in first]
    mean = 1000.5
    same = sum((a - mean) * (b - mean) for a, b in pairs) / sum((a - mean) ** 2 for a, _ in pairs)
    assert abs(same) < 0.1


def test_resuming_needs_no_sort_and_batches_read_their_rows(spark):
    numbered = sampling.number_rows(spark.range(1000).withColumnRenamed("id", "k"), "k")
    ordered = sampling.epoch_order(numbered, "k", epoch=2)
    resumed = sampling.assign_batches(ordered, 32, skip_batches=20)
    plan = resumed._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Exchange" not in plan
    some = sampling.batch_rows(numbered, "k", [0, 25, 31], 32, epoch=2)
    assert "In(row_number" in some._jdf.queryExecution().executedPlan().toString()
    want = {tuple(r) for r in sampling.assign_batches(ordered, 32).where("batch_id IN (0, 25, 31)").collect()}
    assert {tuple(r) for r in some.collect()} == want and len(want) == 32 + 32 + 8


def test_nothing(spark):
    assert sampling.epoch_order(spark.range(0), "id").count() == 0
