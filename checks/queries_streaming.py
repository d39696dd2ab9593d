"""Views of the metric log, finished and live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.harness import Tables, query
from edulake.streaming import live, metrics

_NEWEST = "SELECT *, row_number() OVER (PARTITION BY run, metric ORDER BY ts DESC, step DESC) AS recency FROM @points"
_TREND = f"""SELECT run, metric, current, delta, CASE WHEN delta IS NULL THEN 'none' WHEN abs(delta) < 1e-6 THEN 'flat' WHEN delta > 0 THEN 'up' ELSE 'down' END AS trend
   FROM (SELECT run, metric, max(CASE WHEN recency = 1 THEN value END) AS current,
     CASE WHEN count(*) >= 5 THEN max(CASE WHEN recency = 1 THEN value END) - max(CASE WHEN recency = 5 THEN value END) END AS delta
     FROM ({_NEWEST}) GROUP BY run, metric)"""


def run_to_end(stream: DataFrame, t: Tables, mode: str) -> DataFrame:
    """Everything a finite stream emits, with the number of its micro-batch."""
    folder = t.scratch

    def keep(batch: DataFrame, number: int) -> None:
        # Overwriting a folder per batch makes a repeated batch harmless.
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/out")


def live_points(t: Tables) -> DataFrame:
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")
    return events.select(
        F.concat(F.lit("run"), F.col("user_id") % 3).alias("run"),
        F.col("event_type").alias("metric"),
        F.col("event_id").alias("step"),
        "ts",
        "value",
    )


@query("rolling_trend", _TREND, doubles=["current", "delta"])
def rolling_trend(t: Tables) -> DataFrame:
    return metrics.rolling_trend(t.points)


@query(
    "stream_rolling_trend",
    f"SELECT t.*, points FROM ({_TREND}) t JOIN (SELECT run, metric, count(*) AS points FROM @points GROUP BY run, metric) USING (run, metric)",
    doubles=["current", "delta"],
    longs=["points"],
)
def stream_rolling_trend(t: Tables) -> DataFrame:
    out = run_to_end(metrics.stream_trend(live_points(t)), t, "update")
    columns = [c for c in out.columns if c not in ("run", "metric", "batch")]
    # The latest emission of every metric is its state at the end.
    last = out.groupBy("run", "metric").agg(F.max_by(F.struct(*columns), "batch").alias("last"))
    return last.select("run", "metric", "last.*")


@query("bounded_history", f"SELECT run, metric, step, value, recency FROM ({_NEWEST}) WHERE recency <= 100", doubles=["value"], longs=["step", "recency"])
def bounded_history(t: Tables) -> DataFrame:
    return metrics.bounded_history(t.points).select("run", "metric", "step", "value", "recency")


@query(
    "elapsed_time",
    "SELECT run, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS elapsed_seconds FROM @points GROUP BY run",
    doubles=["elapsed_seconds"],
)
def elapsed_time(t: Tables) -> DataFrame:
    return metrics.elapsed(t.points)


_RATE = "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS points, count(*) / 3600 AS per_second FROM @points GROUP BY 1"


def _stamped(df: DataFrame) -> DataFrame:
    return df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "points", "per_second")


@query("throughput", _RATE, doubles=["per_second"], longs=["points"])
def throughput(t: Tables) -> DataFrame:
    return _stamped(metrics.throughput(t.points, "1 hour", 3600.0))


@query("stream_throughput", _RATE, doubles=["per_second"], longs=["points"])
def stream_throughput(t: Tables) -> DataFrame:
    out = run_to_end(metrics.throughput(live_points(t), "1 hour", 3600.0, late="2 hours"), t, "update")
    last = out.groupBy("window_start").agg(F.max_by(F.struct("points", "per_second"), "batch").alias("last"))
    return _stamped(last.select("window_start", "last.*"))


@query(
    "eta_minutes",
    """SELECT step, floor((epoch_us(ts) - first_us) / 1000000 / greatest(step - 10, 1) * (last_step - step) / 60) AS eta
       FROM @points, (SELECT epoch_us(min(ts)) AS first_us, max(step) AS last_step FROM @points) WHERE step >= 10""",
    longs=["step", "eta"],
)
def eta_minutes(t: Tables) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = t.points.agg(F.min(micros), F.max("step")).first()
    spent = (micros - F.lit(ends[0])) / 1000000
    eta = metrics.eta_minutes(spent, F.col("step"), F.lit(10), F.lit(ends[1]))
    return t.points.where("step >= 10").select("step", eta.alias("eta"))


_PROGRESS = """SELECT dataset, count(*) AS completed, max(total) AS total, count(*) / max(total) * 100 AS percent, avg(ok) AS accuracy
   FROM (SELECT event_type AS dataset, CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END AS ok FROM @events)
   JOIN (SELECT event_type AS dataset, count(*) * 2 AS total FROM @events GROUP BY 1) USING (dataset) GROUP BY dataset"""


def _results(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("dataset"), (F.col("value") > 20).alias("is_correct"))


def _totals(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("dataset")).agg((F.count("*") * 2).alias("total"))


@query("dataset_progress", _PROGRESS, doubles=["percent", "accuracy"], longs=["completed", "total"])
def dataset_progress(t: Tables) -> DataFrame:
    return metrics.dataset_progress(_results(t.events), _totals(t))


@query("stream_dataset_progress", _PROGRESS, doubles=["percent", "accuracy"], longs=["completed", "total"])
def stream_dataset_progress(t: Tables) -> DataFrame:
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")
    out = run_to_end(metrics.dataset_progress(_results(events), _totals(t)), t, "update")
    fields = F.struct("completed", "total", "percent", "accuracy")
    last = out.groupBy("dataset").agg(F.max_by(fields, "batch").alias("last"))
    return last.select("dataset", "last.*")


def _last(out: DataFrame, *keys: str) -> DataFrame:
    """What the last micro-batch that touched a key says of it."""
    newest = out.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return out.join(newest, [*keys, "batch"]).drop("batch")


@query("stream_bounded_history", f"SELECT run, metric, step, value, recency FROM ({_NEWEST}) WHERE recency <= 100", doubles=["value"], longs=["step", "recency"])
def stream_bounded_history(t: Tables) -> DataFrame:
    live.use_state_store(t.spark)
    out = run_to_end(live.stream_history(live_points(t)), t, "update")
    return _last(out, "run", "metric").select("run", "metric", "step", "value", "recency")


_STEPS = 100_000_000


@query(
    "stream_run_progress",
    f"""SELECT run, spent AS elapsed_seconds, most AS step, floor(spent / greatest(most - least, 1) * ({_STEPS} - most) / 60) AS eta_minutes
      FROM (SELECT run, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS spent, min(step) AS least, max(step) AS most
        FROM @points GROUP BY run)""",
    doubles=["elapsed_seconds"],
    longs=["step", "eta_minutes"],
)
def stream_run_progress(t: Tables) -> DataFrame:
    live.use_state_store(t.spark)
    out = run_to_end(live.stream_run_progress(live_points(t), _STEPS), t, "update")
    return _last(out, "run").select("run", "elapsed_seconds", "step", "eta_minutes")


@query("stream_progress_once", _PROGRESS, doubles=["percent", "accuracy"], longs=["completed", "total"])
def stream_progress_once(t: Tables) -> DataFrame:
    """Every result is delivered twice."""
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")
    again = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")
    results = events.unionByName(again).select(
        F.col("event_type").alias("dataset"), F.col("event_id").alias("sample_id"), "ts", (F.col("value") > 20).alias("is_correct")
    )
    live.use_state_store(t.spark)
    folder, totals = t.scratch, _totals(t)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    writer = live.stream_counts(results, late="365 days").writeStream.outputMode("update")
    writer = writer.foreachBatch(live.with_totals(keep, lambda: totals)).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return _last(t.spark.read.parquet(f"{folder}/out"), "dataset")
