"""Bootstrap, agreement and advantages."""

from __future__ import annotations

import random
import statistics

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import duck
from edulake.functions import poisson
from edulake.operators import bootstrap, checks, rollout


def marks(spark, rows):
    return spark.createDataFrame(rows, "dataset string, value double")


@pytest.mark.parametrize("n", [50, 1000, 2000, 2001, 100_000])
def test_interval_of_a_proportion(spark, n):
    """The interval agrees with the normal one, and moves smoothly with the size of the group."""
    data = spark.range(n).selectExpr("'a' AS dataset", "CAST(id % 5 < 2 AS DOUBLE) AS value")
    row = bootstrap.confidence_intervals(data, ["dataset"]).first()
    spread = 1.96 * (0.4 * 0.6 / n) ** 0.5
    assert row["n"] == n
    assert row["lower"] == pytest.approx(0.4 - spread, abs=0.2 * spread)
    assert row["upper"] == pytest.approx(0.4 + spread, abs=0.2 * spread)
    assert row["p_value"] == pytest.approx(0.001)


@pytest.mark.parametrize("mean", [poisson.BASE**k for k in range(poisson.PLACES)])
def test_counts_have_the_mean_and_variance_of_a_poisson(mean):
    drawn = poisson.counts(np.arange(0, 1 << 31, 10**7), np.arange(1000), mean)
    assert drawn.mean() == pytest.approx(mean, rel=3e-3)
    assert drawn.var() == pytest.approx(mean, rel=2e-2)


@pytest.mark.parametrize("mean", [1, 8, 512])
def test_counts_are_those_of_sql(mean):
    seeds, replicates = np.array([0, 7, 12345, (1 << 31) - 1]), np.arange(50)
    con = duckdb.connect()
    for seed, drawn in zip(seeds, poisson.counts(seeds, replicates, mean), strict=True):
        u = f"(({duck.draw_number(str(seed), 'b')} + 0.5::DOUBLE) / {1 << 31}::DOUBLE)"
        sql = f"SELECT {poisson.quantile_sql('u', 'lam')} FROM (SELECT {u} AS u, {mean} AS lam FROM range(50) r(b) ORDER BY b)"
        assert [r[0] for r in con.execute(sql).fetchall()] == drawn.tolist()


def test_units_of_a_count_add_up(spark):
    numbers = [1, 7, 8, 63, 64, 4095, 4096, 40_961]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", bootstrap._units(F.col("n")).alias("u"))
    for row in rows.collect():
        assert sum(poisson.BASE**u.place for u in row.u) == row.n
        assert len({tuple(u) for u in row.u}) == len(row.u)


def test_vectors_are_all_that_is_handed_on(spark):
    """Two numbers per task, group and replicate leave a task, however many scores it reads."""
    data = spark.range(20_000).selectExpr("concat('g', id % 3) AS dataset", "rand(1) AS value")
    means = bootstrap.resample_means(data, ["dataset"], "value")
    assert means.count() == 3 * bootstrap.REPLICATES
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(sequence(0, 999" not in plan and "MapInArrow" in plan


def test_null_groups_and_null_scores(spark):
    data = marks(spark, [(None, 1.0)] * 6 + [("a", None)] * 6 + [("a", 0.5)] * 7)
    rows = {r["dataset"]: (r["n"], r["lower"], r["upper"]) for r in bootstrap.confidence_intervals(data, ["dataset"]).collect()}
    assert rows == {None: (6, 1.0, 1.0), "a": (7, 0.5, 0.5)}
    assert bootstrap.confidence_intervals(data.limit(0), ["dataset"]).count() == 0


def test_small_groups(spark):
    data = marks(spark, [("four", 1.0)] * 4 + [("nine", 1.0)] * 9 + [("ten", 0.0)] * 10)
    rows = {r["dataset"]: r for r in bootstrap.confidence_intervals(data, ["dataset"]).collect()}
    assert (rows["four"]["lower"], rows["four"]["upper"], rows["four"]["p_value"]) == (0.0, 0.0, 1.0)
    assert (rows["nine"]["lower"], rows["nine"]["p_value"]) == (1.0, 0.001)
    assert rows["ten"]["p_value"] == 1.0
    attached = bootstrap.attached_intervals(bootstrap.confidence_intervals(data, ["dataset"])).collect()
    assert [r["dataset"] for r in attached] == ["ten"]


def test_intervals_are_repeatable_with_many_values(spark):
    rng = random.Random(4)
    values = [rng.gauss(0.3, 1) for _ in range(3000)]
    data = marks(spark, [("a", v) for v in values])
    first = bootstrap.confidence_intervals(data.repartition(7), ["dataset"]).first()
    second = bootstrap.confidence_intervals(data.repartition(3), ["dataset"]).first()
    assert first["lower"] == pytest.approx(second["lower"], abs=1e-9)
    spread = 1.96 * statistics.pstdev(values) / 3000**0.5
    assert first["lower"] == pytest.approx(statistics.mean(values) - spread, abs=0.012)


def test_paired_test(spark):
    schema = "dataset string, sample_id long, value double"
    first = [("up", i, float(i % 2)) for i in range(100)] + [("same", i, 1.0) for i in range(50)] + [("cut", 1, 1.0)]
    second = [("up", i, 1.0) for i in range(100)] + [("same", i, 1.0) for i in range(50)] + [("cut", 2, 1.0)]
    rows = bootstrap.paired_p_value(spark.createDataFrame(first, schema), spark.createDataFrame(second, schema)).collect()
    assert {r["dataset"]: r["p_value"] for r in rows} == {"up": 0.0, "same": 1.0, "cut": 1.0}


def test_kappa(spark):
    rows = [(1, 1)] * 20 + [(0, 0)] * 15 + [(1, 0)] * 5 + [(0, 1)] * 10
    row = checks.judge_agreement(spark.createDataFrame(rows, "auto int, judge int")).first()
    assert row["kappa"] == pytest.approx(0.4)
    assert row["disagreements"] == 15
    equal = spark.createDataFrame([(1, 1), (0, 0), (1, 1)], "auto int, judge int")
    assert checks.judge_agreement(equal).first()["kappa"] == pytest.approx(1.0)
    constant = spark.createDataFrame([(1, 1)] * 3, "auto int, judge int")
    assert checks.judge_agreement(constant).first()["kappa"] == 1.0


def test_advantages(spark):
    rows = [(1, 0.1), (1, 0.5), (1, 0.9), (2, 0.4), (2, 0.4), (3, 0.7)] + [(4, i / 300) for i in range(300)]
    done = rollout.group_advantage(spark.createDataFrame(rows, "prompt_id long, reward double")).collect()
    by_prompt = {}
    for row in done:
        by_prompt.setdefault(row["prompt_id"], []).append(row["advantage"])
    assert len(done) == len(rows)
    assert sorted(by_prompt[1]) == pytest.approx([-1.0, 0.0, 1.0])
    assert by_prompt[2] == [0.0, 0.0] and by_prompt[3] == [0.0]
    assert sum(by_prompt[4]) == pytest.approx(0.0, abs=1e-9)


def test_sequence_logp(spark):
    rows = [(1, [-1.0, -2.0, -3.0], [-100, 5, 7]), (2, [-1.0], [-100])]
    df = spark.createDataFrame(rows, "id long, logp array<double>, label array<int>")
    got = {r["id"]: r["s"] for r in df.select("id", rollout.sequence_logp(F.col("logp"), F.col("label")).alias("s")).collect()}
    assert tuple(got[1]) == (-5.0, 2, -2.5)
    assert tuple(got[2]) == (0.0, 0, 0.0)


def test_consistency_rules(spark):
    rows = [
        ("r", "low", 0.01, 0.5, 0.5), ("r", "high", 0.99, 0.5, 0.5), ("r", "steps", 0.8, 0.1, 0.5),
        ("r", "guide", 0.8, 0.5, 0.1), ("r", "none", None, 0.0, 0.0),
    ]
    runs = spark.createDataFrame(rows, "run_id string, dataset string, accuracy double, step_completeness double, scaffolding_rate double")
    found = {(r["dataset"], r["rule"]) for r in checks.consistency_checks(runs).collect()}
    assert found == {
        ("low", "accuracy_low"), ("high", "accuracy_high"), ("steps", "steps_low"), ("guide", "guidance_low"), (None, "spread_wide"),
    }
