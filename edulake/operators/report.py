"""Report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edulake.functions import text as tx


def dataset_report(run: DataFrame) -> DataFrame:
    """Percent texts and a bar for every dataset."""
    return run.select(
        "dataset",
        tx.percent(F.col("accuracy")).alias("accuracy"),
        tx.percent(F.col("step_completeness")).alias("step_completeness"),
        tx.percent(F.col("scaffolding_rate")).alias("scaffolding_rate"),
        F.coalesce("total", F.lit(0)).alias("total"),
        tx.bar(F.col("accuracy")).alias("bar"),
    ).orderBy("dataset")


def baseline_table(baseline: DataFrame, final: DataFrame) -> DataFrame:
    """Accuracy then and now for the datasets both runs have; a missing accuracy counts 0."""
    joined = baseline.select("dataset", F.coalesce("accuracy", F.lit(0.0)).alias("base")).join(
        final.select("dataset", F.coalesce("accuracy", F.lit(0.0)).alias("final")), "dataset"
    )
    delta = F.col("final") - F.col("base")
    return joined.select(
        "dataset",
        tx.percent(F.col("base")).alias("base"),
        tx.percent(F.col("final")).alias("final"),
        delta.alias("delta"),
        tx.signed(delta).alias("change"),
        F.when(F.abs(delta) < 0.01, "flat").when(delta > 0, "up").otherwise("down").alias("trend"),
    ).orderBy("dataset")


def baseline_counts(table: DataFrame) -> DataFrame:
    return table.agg(
        F.count_if(F.col("trend") == "up").alias("improved"), F.count_if(F.col("trend") == "down").alias("regressed")
    )


def weakest_datasets(run: DataFrame, n: int = 5) -> DataFrame:
    """The n datasets of lowest accuracy, ranked, with advice."""
    top = run.where("accuracy is not null").orderBy("accuracy", "dataset").limit(n)
    return top.select(
        F.row_number().over(Window.partitionBy().orderBy("accuracy", "dataset")).alias("rank"),
        "dataset",
        "accuracy",
        F.when(F.col("accuracy") < 0.3, "focus").when(F.col("accuracy") < 0.5, "more").otherwise("keep").alias("advice"),
    )


def interval_table(runs: DataFrame) -> DataFrame:
    """One row per dataset and metric of a run table whose rows hold a map of intervals."""
    bounds = [tx.fixed(F.coalesce(c, F.lit(0.0)), 3) for c in ("ci.lower", "ci.upper")]
    return runs.select("run_id", "dataset", F.explode("confidence_intervals").alias("metric", "ci")).select(
        "run_id",
        "dataset",
        "metric",
        F.concat(F.lit("["), bounds[0], F.lit(", "), bounds[1], F.lit("]")).alias("interval"),
    )


def report_name(headers: DataFrame, extension: str = "md") -> DataFrame:
    """File name of a report from stage, time and average accuracy (``stage``, ``ts``, ``macro_accuracy``)."""
    stamp = F.date_format(F.to_timestamp("ts", "yyyyMMdd_HHmmss"), "yyyyMMdd_HHmm")
    plain = F.concat_ws("_", "stage", stamp)
    name = F.when(
        F.col("macro_accuracy").isNotNull(), F.concat(plain, F.lit("_acc"), tx.fixed(F.col("macro_accuracy"), 4))
    ).otherwise(plain)
    return headers.select("run_id", F.concat(name, F.lit("." + extension)).alias("report_name"))
