"""Evaluation runs: nested JSON documents, flat JSON documents, and the run table."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edulake.schema import EVAL_RUN


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run documents, one per file; the pointer and audit files beside them are left out."""
    rows = spark.read.schema(EVAL_RUN).option("multiLine", True).json(path)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return (
        rows.withColumn("run_id", F.replace(name, F.lit(".json"), F.lit("")))
        .where(~F.col("run_id").isin("latest", "audit_samples"))
        .withColumnRenamed("timestamp", "ts")
    )


def flatten_runs(runs: DataFrame) -> DataFrame:
    """One row per run and dataset."""
    exploded = runs.select("run_id", "stage", "ts", "model_path", F.explode("datasets").alias("dataset", "result"))
    return exploded.select("run_id", "stage", "ts", "model_path", "dataset", "result.*")


#: Numbers of a result that are no metrics.
NO_METRICS = ("total", "p_value", "lower", "upper")


def read_run_results(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """One row per run and dataset with the whole ``result`` as JSON, its ``error`` if it failed, and the run's own
    ``weighted_accuracy``. A document is a file, or a line; the file's name is the run unless the document names it.
    """
    schema = (
        "run_id string, timestamp string, stage string, model_path string, datasets map<string, string>, "
        "aggregate struct<weighted_accuracy: double, weakest_datasets: array<string>>"
    )
    rows = spark.read.schema(schema).option("multiLine", not one_per_line).json(path)
    name = F.replace(F.element_at(F.split(F.input_file_name(), "/"), -1), F.lit(".json"), F.lit(""))
    named = rows.withColumn("run_id", F.coalesce("run_id", name))
    named = named.where(~F.col("run_id").isin("latest", "audit_samples"))
    return named.select(
        "run_id",
        "stage",
        F.col("timestamp").alias("ts"),
        "model_path",
        F.col("aggregate.weighted_accuracy").alias("weighted_accuracy"),
        F.explode("datasets").alias("dataset", "result"),
    ).withColumn("error", F.get_json_object("result", "$.error"))


def result_metrics(results: DataFrame) -> DataFrame:
    """Every numeric entry of every result but counts and interval bounds, as ``metric`` and ``value``."""
    entries = F.from_json("result", "map<string, string>")
    ids = [c for c in ("run_id", "stage", "ts", "model_path", "dataset") if c in results.columns]
    total = F.try_element_at(entries, F.lit("total")).try_cast("bigint").alias("total")
    each = results.select(*ids, total, F.explode(entries).alias("metric", "text"))
    value = F.col("text").try_cast("double")
    return each.where(~F.col("metric").isin(*NO_METRICS)).select(*ids, "total", "metric", value.alias("value")).where(
        "value IS NOT NULL"
    )


def raw_samples(runs: DataFrame) -> DataFrame:
    """One row per stored sample of every run and dataset."""
    flat = flatten_runs(runs)
    return flat.select("run_id", "dataset", F.posexplode("raw_samples").alias("sample_id", "sample")).select(
        "run_id", "dataset", "sample_id", "sample.*"
    )


def read_flat_runs(spark: SparkSession, path: str) -> DataFrame:
    """``run_id``, ``key`` and ``value`` rows of flat run documents; entries that are no numbers are left out."""
    schema = T.MapType(T.StringType(), T.StringType())
    lines = spark.read.option("wholetext", True).text(path)
    name = F.replace(F.element_at(F.split(F.input_file_name(), "/"), -1), F.lit(".json"), F.lit(""))
    entries = lines.select(name.alias("run_id"), F.explode(F.from_json("value", schema)).alias("key", "text"))
    return entries.select("run_id", "key", F.col("text").try_cast("double").alias("value")).where("value is not null")


def _rows(path: str) -> str:
    return f"{path.rstrip('/')}/rows"


def _commits(path: str) -> str:
    return f"{path.rstrip('/')}/commits"


def stage_run(
    summary: DataFrame, path: str, run_id: str, stage: str, ts: str, model_path: str = "", attempt: str | None = None
) -> str:
    """Write one run's rows under an attempt of its own, which readers do not see yet. Gives the attempt."""
    attempt = attempt or f"a{time.time_ns():020d}-{uuid.uuid4().hex}"
    stamped = summary.select(
        F.lit(run_id).alias("run_id"),
        F.lit(ts).alias("ts"),
        F.lit(model_path).alias("model_path"),
        F.lit(stage).alias("stage"),
        "*",
        F.lit(attempt).alias("attempt"),
    )
    stamped.write.mode("append").partitionBy("attempt").parquet(_rows(path))
    return attempt


def commit_run(spark: SparkSession, path: str, run_id: str, attempt: str) -> None:
    """Publish an attempt as the run's rows. Publishing again changes nothing; a later attempt takes the place of others."""
    record = spark.createDataFrame([(run_id, attempt)], "run_id string, attempt string")
    record.coalesce(1).write.mode("append").parquet(_commits(path))


def append_run(summary: DataFrame, path: str, run_id: str, stage: str, ts: str, model_path: str = "") -> None:
    """Add one run, a row per dataset, to the run table. The newest run is found by time.

    The rows are written first and count only once a commit record names them. So a run that broke off stays invisible,
    and a run that is appended again, after a lost answer, is there once.
    """
    attempt = stage_run(summary, path, run_id, stage, ts, model_path)
    commit_run(summary.sparkSession, path, run_id, attempt)


def read_run_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last published attempt of every run. Attempts sort by the time they began."""
    commits = spark.read.schema("run_id string, attempt string").parquet(_commits(path))
    published = commits.groupBy("run_id").agg(F.max("attempt").alias("attempt"))
    rows = spark.read.option("mergeSchema", "true").parquet(_rows(path))
    return rows.join(published, ["run_id", "attempt"], "left_semi").drop("attempt")


def write_json(df: DataFrame, path: str, columns: Iterable[str] | None = None) -> None:
    """Weights, wrong samples or audit lists as JSON lines."""
    (df.select(*columns) if columns else df).write.mode("overwrite").json(path)
