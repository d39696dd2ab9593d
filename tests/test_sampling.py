"""Splits and samples on a table whose hot dataset holds more than a third of all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from edulake.functions import bloom
from edulake.operators import ranking, sampling, split


@pytest.fixture(scope="module")
def rows(spark):
    dataset = F.when(F.col("id") % 5 < 2, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 7))
    return spark.range(5000).select(F.col("id").alias("key"), dataset.alias("dataset")).cache()


def holdout(total: int, ratio: float, cap: int) -> int:
    return min(max(min(int(total * ratio), cap), 10), total - 10)


@pytest.mark.parametrize(("total", "expected"), [(1000, 50), (100, 10), (15, 5), (10, 0), (20000, 500)])
def test_holdout_size(spark, total, expected):
    rows = spark.range(total).select(F.col("id").alias("key"), F.lit("a").alias("dataset"))
    assert split.holdout_split(rows, "key").where("split = 'eval'").count() == expected


def test_holdout_refuses_tiny_datasets(spark):
    rows = spark.range(9).select(F.col("id").alias("key"), F.lit("a").alias("dataset"))
    with pytest.raises(ValueError):
        split.holdout_split(rows, "key")


def test_holdout_is_exact_and_complete(rows):
    done = split.holdout_split(rows, "key")
    assert done.count() == done.select("key").distinct().count() == rows.count()
    sizes = {r["dataset"]: r["count"] for r in rows.groupBy("dataset").count().collect()}
    held = {r["dataset"]: r["count"] for r in done.where("split = 'eval'").groupBy("dataset").count().collect()}
    assert held == {d: holdout(n, 0.05, 500) for d, n in sizes.items()}


def test_split_column_is_kept(rows):
    marked = rows.withColumn("split", F.lit("given"))
    assert {r[0] for r in split.holdout_split(marked, "key").select("split").distinct().collect()} == {"given"}


def test_grouped_split_leaks_nothing(rows):
    copies = rows.withColumn("question", F.concat(F.lit("question "), F.col("key") % 300))
    # One question makes up a third of all rows.
    copies = copies.withColumn("question", F.when(F.col("key") % 3 == 0, "hot question").otherwise(F.col("question")))
    plain = split.holdout_split(copies.withColumn("dataset", F.lit("a")), "key")
    assert split.leaked_prefixes(plain).count() > 0
    grouped = split.holdout_split(copies.withColumn("dataset", F.lit("a")), "key", group_key="question")
    assert split.leaked_prefixes(grouped).count() == 0
    assert grouped.count() == rows.count()


def test_rank_is_a_permutation(rows):
    ranked = sampling.epoch_order(rows, "key", epoch=1)
    positions = sorted(r["position"] for r in ranked.collect())
    assert positions == list(range(1, 5001))
    other = sampling.epoch_order(rows, "key", epoch=2)
    assert ranked.join(other, ["key", "position"]).count() < 50


def test_rank_within_groups(rows):
    ranked = ranking.with_rank(rows, ["dataset"], "key", "42")
    bad = ranked.groupBy("dataset").agg(F.max("position").alias("m"), F.countDistinct("position").alias("d"), F.count("*").alias("n"))
    assert bad.where("m <> n or d <> n").count() == 0


def test_first_rows_of_clustered_ids(spark):
    ids = [0, 1, 2, 3, 5, 8, 10**12, 10**12 + 1, 10**15, 10**15 + 7]
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    for n in (0, 1, 4, 6, 7, 9, 10, 50):
        got = sorted(r["id"] for r in ranking.first_by_id(rows, "id", n).collect())
        assert got == ids[:n]


def test_fraction_and_cap(rows):
    assert sampling.fraction_sample(rows, "key", 0.25).count() == 1250
    assert sampling.fraction_sample(rows, "key", 0.25, cap=100).count() == 100
    assert sampling.random_n(rows, "key", 10**6).count() == 5000
    assert sampling.random_n(rows, "key", 0).count() == 0


def test_curated_sample(spark, rows):
    quotas = spark.createDataFrame([("hot", 1500), ("d1", 10**6), ("missing", 5)], "dataset string, quota long")
    got = {r["dataset"]: r["count"] for r in sampling.curated_sample(rows, quotas, "key").groupBy("dataset").count().collect()}
    size = rows.where("dataset = 'd1'").count()
    assert got == {"hot": 1500, "d1": size}


def test_weighted_draws_follow_square_root(rows):
    draws = sampling.weighted_draws(rows, "key", draws=40000)
    assert draws.count() == 40000
    sizes = {r["dataset"]: r["count"] for r in rows.groupBy("dataset").count().collect()}
    mass = sum(n**0.5 for n in sizes.values())
    got = {r["dataset"]: r["count"] for r in draws.groupBy("dataset").count().collect()}
    for name, n in sizes.items():
        assert got[name] / 40000 == pytest.approx(n**0.5 / mass, abs=0.01)
    assert draws.select("key").distinct().count() > 4800


def test_draws_ignore_datasets_of_weight_zero(spark, rows):
    weights = spark.createDataFrame([("hot", 0.0)], "dataset string, weight double")
    draws = sampling.weighted_draws(rows, "key", draws=3000, multipliers=weights)
    assert draws.count() == 3000
    assert draws.where("dataset = 'hot'").count() == 0


def test_batches_and_resume(rows):
    order = sampling.epoch_order(rows, "key")
    batches = sampling.assign_batches(order, 48, skip_batches=3)
    sizes = {r["batch_id"]: r["count"] for r in batches.groupBy("batch_id").count().collect()}
    assert min(sizes) == 3 and len(sizes) == -(-5000 // 48) - 3
    assert sizes[max(sizes)] == 5000 % 48
    assert sampling.resume_position(5000, 48, 250) == (2, 250 - 2 * 104)
    shards = sampling.shard(order, 3).groupBy("worker").count().collect()
    assert sorted(r["count"] for r in shards) == [1666, 1667, 1667]


def test_audit_sample(spark):
    rows = spark.range(1900).select(F.col("id").alias("sample_id"), F.concat(F.lit("d"), F.col("id") % 19).alias("dataset"))
    audit = sampling.audit_sample(rows, "sample_id", n=50).collect()
    assert len(audit) == 38
    assert audit[0]["audit_id"] == "d0_000" and audit[1]["audit_id"] == "d0_001"


def test_raw_sample_cap_cuts_before_the_shuffle(rows):
    capped = split.raw_sample_cap(rows, "key", n=100)
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert capped.groupBy("dataset").count().where("count > 100").count() == 0


@pytest.fixture(scope="module")
def uneven(spark):
    """Repeated string keys, a null dataset, a null key."""
    rows = [(f"k{i % 5}", "a") for i in range(100)] + [(f"u{i}", None) for i in range(60)]
    rows += [(f"v{i}", "b") for i in range(40)] + [(None, "b")] * 3
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "key string, dataset string, row long").cache()


def by_dataset(df):
    return {r["dataset"]: r["count"] for r in df.groupBy("dataset").count().collect()}


def test_split_returns_every_row_once(uneven):
    done = split.holdout_split(uneven, "key")
    assert sorted(r["row"] for r in done.collect()) == list(range(203))
    assert by_dataset(done.where("split = 'eval'")) == {"a": 10, None: 10, "b": 10}


def test_split_settings_may_leave_datasets_out(spark, uneven):
    settings = spark.createDataFrame([("a", 0.5, 20), (None, 0.5, 500)], "dataset string, eval_ratio double, eval_cap long")
    done = split.holdout_split(uneven, "key", settings=settings)
    assert done.count() == 203
    assert by_dataset(done.where("split = 'eval'")) == {"a": 20, None: 30, "b": 10}


def test_samples_of_repeated_keys_are_exact(spark, uneven):
    for n in (0, 1, 7, 33, 203, 500):
        drawn = sampling.random_n(uneven, "key", n)
        assert drawn.count() == drawn.select("row").distinct().count() == min(n, 203)
    assert sampling.fraction_sample(uneven, "key", 0.5).count() == 101
    quotas = spark.createDataFrame([("a", 33), (None, 7)], "dataset string, quota long")
    assert by_dataset(sampling.curated_sample(uneven, quotas, "key")) == {"a": 33, None: 7}
    assert by_dataset(sampling.audit_sample(uneven, "key", n=30)) == {"a": 10, None: 10, "b": 10}


def test_first_rows_of_any_key(spark, uneven):
    ordered = sorted((r["key"] is not None, r["key"] or "") for r in uneven.collect())
    for n in (0, 1, 2, 3, 4, 30, 103, 150, 203, 900):
        got = sorted((r["key"] is not None, r["key"] or "") for r in ranking.first_by_id(uneven, "key", n).collect())
        assert got == ordered[:n]


def test_no_draw_is_lost(uneven):
    draws = sampling.weighted_draws(uneven, "key", draws=1000)
    assert draws.count() == 1000 and by_dataset(draws)[None] > 200


def test_order_of_repeated_keys_is_a_permutation(uneven):
    assert sorted(r["position"] for r in sampling.epoch_order(uneven, "key").collect()) == list(range(1, 204))


def test_bloom_filter_misses_nothing(spark):
    keys = spark.range(0, 3000, 3).select(F.when(F.col("id") > 0, F.concat(F.lit("k"), F.col("id"))).alias("k"))
    own = bloom.BloomFilter(keys, "k")
    asked = spark.range(30_000).select("id", F.when(F.col("id") > 0, F.concat(F.lit("k"), F.col("id"))).alias("k"))
    passed = {r.id for r in asked.where(own.might_contain(F.col("k"))).collect()}
    assert passed >= set(range(0, 3000, 3))
    assert len(passed) < 1000 + 0.03 * 29_000


def test_leakage_moves_only_what_the_filter_passes(spark):
    """Prefixes are found wherever they occur, null ones too; other training rows reach no exchange."""
    rows = [(f"question {k}", "train") for k in range(5000)] + [(f"question {k * 100}", "eval") for k in range(70)]
    rows += [(None, "train"), (None, "eval"), ("x" * 150, "eval"), ("x" * 120, "train"), ("question 7", "other")]
    df = spark.createDataFrame(rows, "question string, split string")
    found = split.leaked_prefixes(df)
    assert {r.prefix for r in found.collect()} == {f"question {k}" for k in range(0, 5000, 100)} | {None, "x" * 100}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "scalar-subquery" in plan.lower() or "subquery" in plan.lower()
    leaked = split.leaked_rows(df)
    assert leaked.count() == 2 * 50 + 2 and set(leaked.columns) == {"question", "split", "prefix"}
    assert split.leaked_prefixes(df.limit(0)).count() == 0
