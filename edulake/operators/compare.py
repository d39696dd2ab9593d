"""Comparing two runs, and the verdicts drawn from the comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edulake.functions.numeric import normal_cdf

DEFAULT_TOTAL = 100
MIN_TOTAL = 10


def proportion_variance(value: Column, total: Column) -> Column:
    """v(1-v)/n; a value outside [0, 1] counts as no variance."""
    return F.greatest(value * (1 - value), F.lit(0.0)) / F.greatest(total, F.lit(MIN_TOTAL))


def compare_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Metric by metric change between two long runs, over the datasets both have.

    A metric one run lacks counts 0 there. The interval is the second value with the first value's spread, and
    the p-value is that of a two-sided z-test.
    """

    def side(run: DataFrame, n: str) -> DataFrame:
        totals = run.groupBy("dataset").agg(F.max("total").alias("total_" + n))
        return run.select("dataset", "metric", F.col("value").alias("v" + n)).join(totals, "dataset")

    a, b = side(first, "1"), side(second, "2")
    common = a.select("dataset").distinct().join(b.select("dataset").distinct(), "dataset")
    totals = (
        common.join(a.groupBy("dataset").agg(F.max("total_1").alias("n1")), "dataset")
        .join(b.groupBy("dataset").agg(F.max("total_2").alias("n2")), "dataset")
        .select("dataset", *[F.coalesce(c, F.lit(DEFAULT_TOTAL)).alias(c) for c in ("n1", "n2")])
    )
    both = (
        a.select("dataset", "metric", "v1")
        .join(b.select("dataset", "metric", "v2"), ["dataset", "metric"], "full_outer")
        .join(totals, "dataset")
        .select("dataset", "metric", "n1", "n2", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in ("v1", "v2")])
    )
    spread_1 = proportion_variance(F.col("v1"), F.col("n1"))
    spread_2 = proportion_variance(F.col("v2"), F.col("n2"))
    delta = F.col("v2") - F.col("v1")
    z = F.abs(delta) / F.greatest(F.sqrt(spread_1 + spread_2), F.lit(1e-6))
    return both.select(
        "*",
        delta.alias("delta"),
        (F.col("v2") - 1.96 * F.sqrt(spread_1)).alias("ci_low"),
        (F.col("v2") + 1.96 * F.sqrt(spread_1)).alias("ci_high"),
        (2 * (1 - normal_cdf(z))).alias("p_value"),
    )


def trend(delta: Column, p_value: Column, flat: float = 0.01, alpha: float = 0.05) -> Column:
    return (
        F.when(F.abs(delta) < flat, "flat")
        .when((p_value < alpha) & (delta > 0), "up_significant")
        .when((p_value < alpha) & (delta < 0), "down_significant")
        .when(delta > 0, "up_slight")
        .otherwise("down_slight")
    )


def with_trend(comparison: DataFrame) -> DataFrame:
    return comparison.withColumn("trend", trend(F.col("delta"), F.col("p_value")))


def trend_counts(comparison: DataFrame) -> DataFrame:
    """All rises count as improved, only significant falls as regressed."""
    return comparison.agg(
        F.count_if(F.col("trend").isin("up_significant", "up_slight")).alias("improved"),
        F.count_if(F.col("trend") == "down_significant").alias("regressed"),
    )


def weak_metrics(comparison: DataFrame) -> DataFrame:
    """Significant falls."""
    return comparison.where(F.col("trend") == "down_significant").select("dataset", "metric", "delta")


def compare_flat(first: DataFrame, second: DataFrame, flat: float = 0.001) -> DataFrame:
    """Change of every key of two flat runs (``key``, ``value``); a missing key counts 0."""
    joined = first.select("key", F.col("value").alias("v1")).join(
        second.select("key", F.col("value").alias("v2")), "key", "full_outer"
    )
    filled = joined.select("key", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in ("v1", "v2")])
    delta = F.col("v2") - F.col("v1")
    return filled.select(
        "*",
        delta.alias("delta"),
        F.when(F.abs(delta) < flat, "flat").when(delta > 0, "up").otherwise("down").alias("trend"),
    )


def flat_verdict(comparison: DataFrame) -> DataFrame:
    """Rises against falls."""
    counts = comparison.agg(
        F.count_if(F.col("trend") == "up").alias("improved"), F.count_if(F.col("trend") == "down").alias("regressed")
    )
    return counts.withColumn(
        "verdict",
        F.when(F.col("regressed") > F.col("improved"), "regressed")
        .when(F.col("improved") > F.col("regressed"), "improved")
        .otherwise("unchanged"),
    )


def regression_verdict(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Accuracy drop of every dataset against its baseline; without a baseline it is safe.

    A dataset that failed in the current run, and so has no accuracy, counts as 0.
    """
    base = baseline.select(
        "dataset", F.col("accuracy").alias("base_accuracy"), F.col("step_completeness").alias("base_steps")
    )
    joined = current.select("dataset", "accuracy", "step_completeness").join(base, "dataset", "left")
    drop = F.col("base_accuracy") - F.coalesce("accuracy", F.lit(0.0))
    verdict = (
        F.when(F.col("base_accuracy").isNull(), "no_baseline")
        .when(drop > 0.10, "severe")
        .when(drop > 0.05, "mild")
        .otherwise("fine")
    )
    return joined.select(
        "dataset",
        drop.alias("accuracy_drop"),
        (F.col("base_steps") - F.coalesce("step_completeness", F.lit(0.0))).alias("step_drop"),
        verdict.alias("verdict"),
        (verdict != "severe").alias("safe"),
    )


def regression_verdict_tested(comparison: DataFrame) -> DataFrame:
    """Verdict on the accuracy rows of a comparison from the size of the drop and its p-value."""
    drop = -F.col("delta")
    p = F.col("p_value")
    return comparison.where(F.col("metric") == "accuracy").select(
        "dataset",
        drop.alias("accuracy_drop"),
        "p_value",
        F.when((drop > 0.10) & (p < 0.01), "severe")
        .when((drop > 0.05) & (p < 0.05), "significant")
        .when(drop > 0.02, "minor")
        .otherwise("safe")
        .alias("verdict"),
    )


def optimisation_verdict(scores: DataFrame, tuned: str = "grpo_accuracy", base: str = "sft_accuracy") -> DataFrame:
    """What to do after policy training, from its accuracy and that of the run it started from.

    Without a policy run there is nothing to judge; without the run it started from it is good.
    """
    g, s = F.col(tuned), F.col(base)
    verdict = (
        F.when(g.isNull(), "no_policy_run")
        .when(s.isNull(), "good")
        .when(g < s * 0.95, "severe")
        .when((g < s * 1.02) & (g < s), "fallback_slight")
        .when(g < s * 1.02, "fallback")
        .when(g < s * 1.05, "combined")
        .otherwise("good")
    )
    return scores.withColumn("verdict", verdict).withColumn("change", F.try_divide(g - s, s))
