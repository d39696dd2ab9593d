"""Selecting evaluation runs. A run table holds one row per run and dataset (and metric in its long form)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edulake.schema import METRICS


def run_headers(runs: DataFrame) -> DataFrame:
    """One row per run."""
    return runs.groupBy("run_id", "stage", "ts").agg(F.countDistinct("dataset").alias("datasets"))


def latest_runs(runs: DataFrame, n: int = 1, stage: str | None = None) -> DataFrame:
    """The newest n runs, by time, numbered from the newest."""
    headers = runs.select("run_id", "stage", "ts").distinct()
    if stage is not None:
        headers = headers.where(F.col("stage") == stage)
    top = headers.orderBy(F.desc("ts"), F.desc("run_id")).limit(n)
    return top.withColumn(
        "recency", F.row_number().over(Window.partitionBy().orderBy(F.desc("ts"), F.desc("run_id")))
    )


def latest_per_stage(runs: DataFrame, n: int = 1) -> DataFrame:
    """The newest n runs of every stage."""
    headers = runs.select("run_id", "stage", "ts").distinct()
    order = Window.partitionBy("stage").orderBy(F.desc("ts"), F.desc("run_id"))
    return headers.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= n)


def pick(runs: DataFrame, headers: DataFrame, recency: int = 1) -> DataFrame:
    """All rows of one selected run."""
    return runs.join(headers.where(F.col("recency") == recency).select("run_id"), "run_id", "left_semi")


def to_long(runs: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per run, dataset and metric; missing metrics are left out."""
    ids = [c for c in ("run_id", "stage", "ts", "model_path", "dataset", "total") if c in runs.columns]
    return runs.unpivot(ids, list(metrics), "metric", "value").where("value is not null")


def run_health(runs: DataFrame, n: int = 20) -> DataFrame:
    """Runs per stage, in all and among the latest n."""
    recent = latest_runs(runs, n).select("run_id", F.lit(1).alias("recent"))
    headers = runs.select("run_id", "stage", "ts").distinct()
    return (
        headers.join(recent, "run_id", "left")
        .groupBy("stage")
        .agg(F.count("*").alias("runs"), F.count("recent").alias("recent_runs"))
    )


def accuracy_stability(runs: DataFrame, n: int = 20) -> DataFrame:
    """Variance of every dataset's accuracy over the latest n runs."""
    recent = latest_runs(runs, n).select("run_id")
    return (
        runs.join(recent, "run_id", "left_semi")
        .groupBy("dataset")
        .agg(F.count("accuracy").alias("runs"), F.var_pop("accuracy").alias("accuracy_variance"))
    )
