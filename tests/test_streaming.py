"""Streams give what the finished log gives."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from edulake.sources import metric_log
from edulake.streaming import metrics

START = dt.datetime(2026, 1, 1)


def write_log(folder, files):
    folder.mkdir(parents=True, exist_ok=True)
    for number, rows in enumerate(files):
        lines = [
            json.dumps({"step": step, "time": (START + dt.timedelta(seconds=second)).isoformat(), metric: value})
            for metric, step, second, value in rows
        ]
        file = folder / f"{number}.jsonl"
        file.write_text("\n".join(lines))
        # Files are taken in order of their time.
        os.utime(file, (1_700_000_000 + number, 1_700_000_000 + number))


@pytest.fixture
def log(tmp_path):
    loss = [("loss", i, i, 1.0 / (i + 1)) for i in range(130)]
    flat = [("flat", i, i, 0.5) for i in range(5)]
    short = [("short", i, i, float(i)) for i in range(4)]
    rows = loss + flat + short
    write_log(tmp_path / "log", [rows[0:60], rows[60:70], rows[70:]])
    return str(tmp_path / "log")


def finish(stream, tmp_path, mode):
    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{tmp_path}/out")


def test_trend_of_stream_and_of_finished_log(spark, log, tmp_path):
    done = {r["metric"]: r for r in metrics.rolling_trend(metric_log.read_log(spark, log, "a")).collect()}
    assert done["short"]["trend"] == "none" and done["short"]["delta"] is None
    assert done["flat"]["trend"] == "flat" and done["loss"]["trend"] == "down"
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(log)
    out = finish(metrics.stream_trend(metric_log.to_points(lines, run="a")), tmp_path, "update")
    assert out.select("batch").distinct().count() == 3
    last = out.groupBy("metric").agg(F.max_by(F.struct("points", "current", "delta", "trend"), "batch").alias("last"))
    live = {r["metric"]: r["last"] for r in last.collect()}
    assert {m: live[m]["points"] for m in live} == {"loss": 130, "flat": 5, "short": 4}
    for metric, row in done.items():
        assert live[metric]["trend"] == row["trend"]
        assert live[metric]["current"] == row["current"]
        assert live[metric]["delta"] == pytest.approx(row["delta"]) if row["delta"] is not None else live[metric]["delta"] is None


def test_history_and_elapsed(spark, log):
    points = metric_log.read_log(spark, log, "a")
    counts = {r["metric"]: r["count"] for r in metrics.bounded_history(points).groupBy("metric").count().collect()}
    assert counts == {"loss": 100, "flat": 5, "short": 4}
    assert metrics.elapsed(points).first()["elapsed_seconds"] == 129.0


def test_throughput_drops_only_late_points(spark, tmp_path):
    on_time = [("x", i, i * 30, 1.0) for i in range(20)]
    # A point counts as late from the second batch after the one that moved the watermark past it.
    files = [on_time, [("x", 99, 36000, 1.0)], [("x", 100, 36001, 1.0)], [("x", 101, 5, 1.0), ("x", 102, 36002, 1.0)]]
    write_log(tmp_path / "log", files)
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "log"))
    stream = metrics.throughput(metric_log.to_points(lines, run="a"), late="10 minutes")
    out = finish(stream, tmp_path, "update")
    last = out.groupBy("window_start").agg(F.max_by("points", "batch").alias("points"))
    counts = {r["window_start"]: r["points"] for r in last.collect()}
    assert counts[START] == 2
    assert counts[START + dt.timedelta(seconds=36000)] == 3
    assert len(counts) == 11


def test_log_is_appended_by_a_stream(spark, log, tmp_path):
    points = metric_log.stream_log(spark, log, "a")
    query = metric_log.stream_append(points, f"{tmp_path}/copy", f"{tmp_path}/copy_state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert metric_log.read_log(spark, f"{tmp_path}/copy", "a").count() == 139


def test_eta(one):
    eta = metrics.eta_minutes(F.col("spent"), F.col("step"), F.lit(0), F.lit(100))
    assert one(eta, "spent double, step long", 600.0, 10) == 90
