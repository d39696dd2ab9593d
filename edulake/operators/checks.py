"""Checks of an evaluation itself: consistency of its metrics, and agreement with a judge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def consistency_checks(runs: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Findings per run: accuracies out of range, metrics that contradict each other, widely spread datasets."""
    by = list(by)
    accuracy, steps, guidance = F.col("accuracy"), F.col("step_completeness"), F.col("scaffolding_rate")
    rules = [
        ("accuracy_low", "issue", accuracy < 0.05, accuracy),
        ("accuracy_high", "warning", accuracy > 0.98, accuracy),
        ("steps_low", "warning", (accuracy > 0.7) & (steps < 0.3), steps),
        ("guidance_low", "warning", (accuracy > 0.7) & (guidance < 0.2), guidance),
    ]
    findings = F.array_compact(
        F.array(
            *[
                F.when(
                    condition,
                    F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), value.alias("value")),
                )
                for rule, level, condition, value in rules
            ]
        )
    )
    per_dataset = runs.select(*by, "dataset", F.inline(findings))
    per_run = (
        runs.groupBy(*by)
        .agg(F.count("accuracy").alias("n"), F.stddev_pop("accuracy").alias("value"))
        .where("n >= 3 and value > 0.3")
        .select(
            *by,
            F.lit(None).cast("string").alias("dataset"),
            F.lit("spread_wide").alias("rule"),
            F.lit("warning").alias("level"),
            "value",
        )
    )
    return per_dataset.unionByName(per_run)


def judge_agreement(df: DataFrame, auto: str = "auto", judge: str = "judge", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy by the automatic mark and by the judge, Cohen's kappa, and the number of disagreements."""
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.col(auto).cast("double")).alias("auto_accuracy"),
        F.avg(F.col(judge).cast("double")).alias("judge_accuracy"),
        F.count_if(F.col(auto) != F.col(judge)).alias("disagreements"),
    )
    a, j = F.col("auto_accuracy"), F.col("judge_accuracy")
    observed = 1 - F.col("disagreements") / F.col("n")
    expected = a * j + (1 - a) * (1 - j)
    # Two constant and equal marks agree fully although chance would do the same.
    kappa = F.coalesce(F.try_divide(observed - expected, 1 - expected), F.lit(1.0))
    return counts.withColumn("kappa", kappa).withColumn(
        "agreement", F.when(F.col("kappa") > 0.8, "almost_perfect").when(F.col("kappa") > 0.6, "high").otherwise("fair")
    )


def disagreements(df: DataFrame, auto: str = "auto", judge: str = "judge") -> DataFrame:
    """Rows on which the automatic mark and the judge differ."""
    return df.where(F.col(auto) != F.col(judge))
