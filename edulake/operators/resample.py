"""Turning evaluation scores into sampling weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edulake.functions.numeric import clamp, round_exact

DEFAULT_SCORE = 0.5
DEFAULT_SAMPLES = 100


def dataset_scores(run: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """One score per dataset: the accuracy, or the first other metric there is.

    ``legacy`` holds flat ``key``/``value`` rows such as ``accuracy_x``; they serve datasets not scored yet.
    """
    candidates = [c for c in ("accuracy", "step_completeness", "kw_match", "score") if c in run.columns]
    scores = run.select(
        "dataset",
        F.coalesce(*[F.col(c) for c in candidates]).cast("double").alias("score"),
        F.coalesce("total", F.lit(DEFAULT_SAMPLES)).cast("bigint").alias("n_samples"),
    ).where("score is not null")
    if legacy is None:
        return scores
    name = F.replace(F.replace("key", F.lit("accuracy_"), F.lit("")), F.lit("kw_match_"), F.lit(""))
    flat = (
        legacy.where(F.col("key").startswith("accuracy_") | F.col("key").startswith("kw_match_"))
        .groupBy(name.alias("dataset"))
        .agg(F.min_by(F.col("value").cast("double"), "key").alias("score"))
        .withColumn("n_samples", F.lit(DEFAULT_SAMPLES).cast("bigint"))
    )
    return scores.unionByName(flat.join(scores, "dataset", "left_anti"))


def weight_v1(score: Column, low: float = 0.3, high: float = 3.0) -> Column:
    return clamp(F.lit(0.5) / F.greatest(score, F.lit(0.01)), low, high)


def weight_v2(score: Column, samples: Column, low: float = 0.5, high: float = 2.5) -> Column:
    correction = F.least(F.lit(1.0), F.log10(samples + 10) / 3.0)
    return clamp((F.sqrt(1.0 - score) + 0.5) * correction, low, high)


def weight_hint(weight: Column) -> Column:
    return F.when(weight > 1.8, "focus").when(weight > 1.3, "more").when(weight < 0.7, "less").otherwise("keep")


def weight_table(
    registry: DataFrame, scores: DataFrame, version: str = "v2", low: float = 0.5, high: float = 2.5
) -> DataFrame:
    """Weight of every registered dataset (``dataset``, ``path``, ``path_exists``).

    A dataset without files weighs 0, one without a score is taken to have 0.5 on 100 samples, and when there is
    no score at all every dataset weighs 1.
    """
    scored = not scores.isEmpty()
    joined = registry.join(scores, "dataset", "left").select(
        "dataset",
        "path",
        "path_exists",
        F.coalesce("score", F.lit(DEFAULT_SCORE)).alias("score"),
        F.coalesce("n_samples", F.lit(DEFAULT_SAMPLES)).alias("n_samples"),
    )
    if not scored:
        return joined.select(
            "*", F.lit(1.0).alias("raw_weight"), F.lit(1.0).alias("weight"), F.lit("keep").alias("hint")
        )
    if version == "v1":
        weight = weight_v1(F.col("score"), low, high)
    else:
        weight = weight_v2(F.col("score"), F.col("n_samples"), low, high)
    return joined.withColumn("raw_weight", F.when(F.col("path_exists"), weight)).select(
        "*",
        F.coalesce(round_exact(F.col("raw_weight"), 3), F.lit(0.0)).alias("weight"),
        F.when(F.col("path_exists"), weight_hint(F.col("raw_weight"))).alias("hint"),
    )


def weight_totals(weights: DataFrame) -> DataFrame:
    return weights.agg(
        F.sum("raw_weight").alias("total_weight"), F.count_if(F.col("weight") > 0).alias("active_datasets")
    )


def compare_weights(scores: DataFrame, registry: DataFrame, n: int = 10) -> DataFrame:
    """Both formulas side by side for the first n scored names, as far as they are registered."""
    first = scores.orderBy("dataset").limit(n)
    v1, v2 = weight_v1(F.col("score")), weight_v2(F.col("score"), F.col("n_samples"))
    return first.join(registry.select("dataset"), "dataset", "left_semi").select(
        "dataset", "score", v1.alias("weight_v1"), v2.alias("weight_v2"), (v2 - v1).alias("change")
    )


def data_paths(weights: DataFrame) -> DataFrame:
    """Paths of all datasets in use, by name, joined by commas. One row per registered dataset goes in."""
    used = weights.where(F.col("weight") > 0)
    entries = F.array_sort(F.collect_list(F.struct("dataset", "path")))
    return used.agg(F.array_join(F.transform(entries, lambda e: e["path"]), ",").alias("data_paths"))


def top_weights(weights: DataFrame, n: int = 10) -> DataFrame:
    return weights.orderBy(F.desc("weight"), "dataset").limit(n)
