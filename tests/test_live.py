"""Stateful streams: histories, runs that end, and results that are delivered twice."""

from __future__ import annotations

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from edulake.streaming import live, metrics

START = dt.datetime(2026, 1, 1)
POINT = "run string, metric string, step long, ts timestamp, value double"
RESULT = "dataset string, sample_id long, ts timestamp, is_correct boolean"


@pytest.fixture(autouse=True)
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    live.use_state_store(spark)
    yield
    spark.conf.set(name, old)


def write_files(folder, files):
    folder.mkdir(parents=True, exist_ok=True)
    for number, rows in enumerate(files):
        file = folder / f"{number}.json"
        file.write_text("\n".join(json.dumps(r, default=str) for r in rows))
        # Files are taken in order of their time.
        os.utime(file, (1_700_000_000 + number, 1_700_000_000 + number))


def point(run, metric, step, second, value):
    return {"run": run, "metric": metric, "step": step, "ts": (START + dt.timedelta(seconds=second)).isoformat(), "value": value}


def run_stream(spark, folder, schema, build, tmp_path, mode="update", wrap=lambda keep: keep):
    """All micro-batches of one file each, as rows with their batch."""
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)))

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(wrap(keep)).option("checkpointLocation", f"{tmp_path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def test_history_with_points_out_of_order_and_repeated(spark, tmp_path):
    choose = random.Random(2)
    rows = [point("r", m, k, k * 7 % 500, k / 3) for m, n in (("loss", 260), ("lr", 100), ("one", 1)) for k in range(n)]
    choose.shuffle(rows)
    files = [rows[:150], rows[150:200], rows[100:170], rows[200:], rows[:5]]
    write_files(tmp_path / "in", files)
    out = run_stream(spark, tmp_path / "in", POINT, live.stream_history, tmp_path)
    assert out.groupBy("batch", "run", "metric").count().agg(F.max("count")).first()[0] == 100
    newest = out.join(out.groupBy("metric").agg(F.max("batch").alias("batch")), ["metric", "batch"])
    got = {(r.metric, r.step, r.recency) for r in newest.collect()}
    whole = spark.createDataFrame([(r["run"], r["metric"], r["step"], r["ts"], r["value"]) for r in rows], POINT.replace("timestamp", "string"))
    done = metrics.bounded_history(whole.withColumn("ts", F.col("ts").cast("timestamp")))
    assert got == {(r.metric, r.step, r.recency) for r in done.collect()}


def test_runs_end_and_late_points_do_not_revive_them(spark, tmp_path):
    hours = 3600
    files = [
        [point("a", "loss", k, 60 * k, 1.0) for k in range(11)],
        [point("b", "loss", 0, 30 * 60, 1.0)],
        # b goes on while a is silent; the next batch sees a's timer expired.
        [point("b", "loss", 50, 4 * hours, 1.0)],
        [point("b", "loss", 60, 4 * hours + 60, 1.0)],
        [point("a", "loss", 11, 700, 1.0), point("b", "loss", 70, 4 * hours + 120, 1.0)],
    ]
    write_files(tmp_path / "in", files)
    out = run_stream(spark, tmp_path / "in", POINT, lambda p: live.stream_run_progress(p, 100), tmp_path)
    rows = sorted(map(tuple, out.select("run", "batch", "elapsed_seconds", "step", "eta_minutes", "finished").collect()))
    a = [r for r in rows if r[0] == "a"]
    assert (a[0][2], a[0][3], a[0][4], a[0][5]) == (600.0, 10, 90, False)
    assert [r[5] for r in a] == [False, True] and a[1][2:5] == (600.0, 10, 90)
    b = [r for r in rows if r[0] == "b"]
    assert b[-1][3] == 70 and not b[-1][5] and b[-1][2] == 4 * hours + 120 - 30 * 60
    state = spark.read.format("statestore").option("stateVarName", "ends").load(f"{tmp_path}/state")
    assert [r.key.run for r in state.select("key").collect()] == ["b"]


def test_results_delivered_twice_count_once(spark, tmp_path):
    rows = [
        {"dataset": f"d{k % 3}", "sample_id": k // 3, "ts": (START + dt.timedelta(seconds=k)).isoformat(), "is_correct": k % 4 == 0}
        for k in range(300)
    ]
    files = [rows[:100], rows[:100], rows[100:200], rows[50:150], rows[200:], rows]
    write_files(tmp_path / "in", files)
    totals = spark.createDataFrame([("d0", 200), ("d1", 100), ("d2", 0), ("d9", 5)], "dataset string, total long")
    out = run_stream(
        spark, tmp_path / "in", RESULT, live.stream_counts, tmp_path, wrap=lambda keep: live.with_totals(keep, lambda: totals)
    )
    last = out.groupBy("dataset").agg(F.max_by(F.struct("completed", "total", "percent", "accuracy"), "batch").alias("x"))
    got = {r.dataset: tuple(r.x) for r in last.collect()}
    once = spark.createDataFrame([(r["dataset"], r["is_correct"]) for r in rows], "dataset string, is_correct boolean")
    assert got == {r.dataset: tuple(r)[1:] for r in metrics.dataset_progress(once, totals).collect()}


def test_totals_are_read_for_every_batch(spark, tmp_path):
    files = [[{"dataset": "d", "sample_id": k, "ts": START.isoformat(), "is_correct": True}] for k in range(3)]
    write_files(tmp_path / "in", files)
    asked = []

    def totals():
        asked.append(len(asked))
        return spark.createDataFrame([("d", 10 * len(asked))], "dataset string, total long")

    out = run_stream(
        spark, tmp_path / "in", RESULT, live.stream_counts, tmp_path, wrap=lambda keep: live.with_totals(keep, totals)
    )
    assert {(r.completed, r.total) for r in out.collect()} == {(1, 10), (2, 20), (3, 30)}
