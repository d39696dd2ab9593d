"""From evaluation runs to sampling weights, the next training sample, and a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edulake.operators import compare, resample, runs, sampling, summary


def resample_from_latest(run_table: DataFrame, registry: DataFrame, version: str = "v2") -> DataFrame:
    """Weights of all registered datasets from the newest run."""
    latest = runs.pick(run_table, runs.latest_runs(run_table))
    return resample.weight_table(registry, resample.dataset_scores(latest), version)


def next_training_sample(
    samples: DataFrame, weights: DataFrame, key: str, draws: int | None = None, epoch: int = 0
) -> DataFrame:
    """Draw training rows with the feedback weights as multipliers of the datasets' own shares."""
    return sampling.weighted_draws(samples, key, draws, epoch=epoch, multipliers=weights)


def policy_verdict(run_table: DataFrame) -> DataFrame:
    """Verdict on the newest policy-trained run against the newest fine-tuned run.

    A run's own ``weighted_accuracy`` counts where the table has one, and the mean over its datasets elsewhere.
    """
    newest = runs.latest_per_stage(run_table).where(F.col("stage").isin("sft", "grpo")).select("run_id")
    chosen = run_table.join(newest, "run_id", "left_semi")
    scores = summary.macro_mean(chosen, ["stage"])
    if "weighted_accuracy" in run_table.columns:
        weighted = chosen.groupBy("stage").agg(F.max("weighted_accuracy").alias("__weighted"))
        scores = scores.join(weighted, "stage").withColumn(
            "macro_accuracy", F.coalesce("__weighted", "macro_accuracy")
        )
    pivoted = scores.agg(
        F.max(F.when(F.col("stage") == "grpo", F.col("macro_accuracy"))).alias("grpo_accuracy"),
        F.max(F.when(F.col("stage") == "sft", F.col("macro_accuracy"))).alias("sft_accuracy"),
    )
    return compare.optimisation_verdict(pivoted)
