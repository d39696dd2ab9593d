"""The append-only metric log: JSON lines of ``step``, ``time`` and any number of named metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RECORD = T.MapType(T.StringType(), T.StringType())


def to_points(lines: DataFrame, line: str = "value", run: str | None = None) -> DataFrame:
    """Long form of log lines: ``run``, ``metric``, ``step``, ``ts``, ``value``; only numbers are kept."""
    run_name = F.lit(run) if run is not None else F.col("run") if "run" in lines.columns else F.lit("")
    parsed = lines.select(run_name.alias("run"), F.from_json(line, _RECORD).alias("record"))
    points = parsed.select(
        "run",
        F.try_element_at("record", F.lit("step")).cast("bigint").alias("step"),
        F.try_to_timestamp(F.try_element_at("record", F.lit("time"))).alias("ts"),
        F.explode(F.map_filter("record", lambda k, _: ~k.isin("step", "time"))).alias("metric", "text"),
    )
    return points.select("run", "metric", "step", "ts", F.col("text").try_cast("double").alias("value")).where(
        "value is not null"
    )


def read_log(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    return to_points(spark.read.text(path), run=run)


def stream_log(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """The log as a stream: every new file is read once."""
    return to_points(spark.readStream.text(path), run=run)


def to_lines(points: DataFrame) -> DataFrame:
    """One log line per point."""
    record = F.map_concat(
        F.create_map(
            F.lit("step"),
            F.col("step").cast("string"),
            F.lit("time"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        ),
        F.create_map(F.col("metric"), F.col("value").cast("string")),
    )
    return points.select(F.to_json(record).alias("value"))


def append_log(points: DataFrame, path: str) -> None:
    to_lines(points).write.mode("append").text(path)


def stream_append(points: DataFrame, path: str, checkpoint: str):
    """Append a stream of points to the log."""
    writer = to_lines(points).writeStream.format("text").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint)
