"""Summaries of scored rows and of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edulake.functions.lexicon import RULE_WEIGHTS
from edulake.functions.numeric import weighted_sum
from edulake.schema import DIMENSIONS, METRICS


def share(flag: Column) -> Column:
    """Share of true flags; a missing flag counts as false."""
    return F.avg(F.coalesce(flag.cast("double"), F.lit(0.0)))


def dataset_summary(df: DataFrame, by: Sequence[str] = ("dataset",), length: str | None = None) -> DataFrame:
    """Rows and the mean of the three flags per dataset, and the mean response length when it is given."""
    measures = [F.count("*").alias("total"), *[share(F.col(m)).alias(m) for m in METRICS]]
    if length:
        measures.append(F.avg(length).alias("avg_response_length"))
    return df.groupBy(*by).agg(*measures)


def reward_summary(df: DataFrame, by: Sequence[str] = (), reward: str = "reward", target: float = 0.5) -> DataFrame:
    """Count, mean, extremes, and the share of rewards above the target."""
    return df.groupBy(*by).agg(
        F.count("*").alias("count"),
        F.avg(reward).alias("mean_reward"),
        F.min(reward).alias("min_reward"),
        F.max(reward).alias("max_reward"),
        F.avg((F.col(reward) > target).cast("double")).alias("share_above"),
    )


def dimension_profile(df: DataFrame, by: Sequence[str] = (), weights: dict[str, float] = RULE_WEIGHTS) -> DataFrame:
    """Mean of every dimension and their weighted total."""
    means = df.groupBy(*by).agg(*[F.avg(d).alias(d) for d in DIMENSIONS])
    return means.withColumn("weighted_total", weighted_sum({d: F.col(d) for d in DIMENSIONS}, weights))


def long_profile(profile: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per dimension."""
    names = [*DIMENSIONS, "weighted_total"]
    return profile.unpivot(list(by), names, "dimension", "score")


def macro_mean(run: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Unweighted mean accuracy over datasets; a failed dataset counts 0."""
    return run.groupBy(*by).agg(F.avg(F.coalesce("accuracy", F.lit(0.0))).alias("macro_accuracy"))


def weighted_accuracy(run: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Mean accuracy weighted by rows."""
    return run.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("accuracy") * F.col("total")), F.sum("total")).alias("weighted_accuracy")
    )


def category_rollup(datasets: DataFrame) -> DataFrame:
    """Datasets and rows per category, with a grand total."""
    return (
        datasets.rollup("category")
        .agg(
            F.count("dataset").alias("datasets"),
            F.sum("train_rows").alias("train_rows"),
            F.sum("eval_rows").alias("eval_rows"),
            F.grouping("category").alias("is_total"),
        )
        .select(
            F.when(F.col("is_total") == 1, F.lit("合计")).otherwise(F.col("category")).alias("category"),
            "datasets",
            "train_rows",
            "eval_rows",
        )
    )


def accuracy_range(run: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Number of datasets and the range and mean of their accuracy."""
    return run.groupBy(*by).agg(
        F.count("*").alias("datasets"),
        F.min("accuracy").alias("min_accuracy"),
        F.max("accuracy").alias("max_accuracy"),
        F.avg("accuracy").alias("mean_accuracy"),
    )


def below_half(run: DataFrame, by: Sequence[str] = ("run_id",), limit: float = 0.5) -> DataFrame:
    """Datasets whose accuracy is below the limit."""
    return run.groupBy(*by).agg(F.count_if(F.col("accuracy") < limit).alias("weak_datasets"))


def load_counts(df: DataFrame, accepted: Column, source: str = "source") -> DataFrame:
    """Kept and skipped rows per source."""
    kept = F.coalesce(accepted, F.lit(False))
    return df.groupBy(source).agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("skipped"))
