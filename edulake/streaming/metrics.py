"""Live views of a metric log. The same functions serve a finished log and a stream where Spark allows it.

Points are rows of ``run``, ``metric``, ``step``, ``ts``, ``value``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from edulake.operators.ranking import first_per_group

KEYS = ("run", "metric")
TREND_POINTS = 5
HISTORY_POINTS = 100
FLAT = 1e-6

TREND_SCHEMA = "run string, metric string, points long, current double, delta double, trend string"
_STATE_SCHEMA = "steps array<long>, times array<double>, values array<double>, points long"


def trend_label(delta: Column, flat: float = FLAT) -> Column:
    return (
        F.when(delta.isNull(), "none").when(F.abs(delta) < flat, "flat").when(delta > 0, "up").otherwise("down")
    )


def newest(points: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The newest n points of every metric, numbered from the newest.

    Parts of a metric are cut to n points each before they meet, so a metric that fills most of the log sends only a
    few rows to any task.
    """
    return first_per_group(points, keys, [F.desc("ts"), F.desc("step")], n, "recency")


def bounded_history(points: DataFrame, n: int = HISTORY_POINTS) -> DataFrame:
    return newest(points, n)


def rolling_trend(points: DataFrame, n: int = TREND_POINTS) -> DataFrame:
    """Current value and the change over the last n points of every metric; no change until there are n."""
    recent = newest(points, n).groupBy(*KEYS).agg(
        F.count("*").alias("points"),
        F.max(F.when(F.col("recency") == 1, F.col("value"))).alias("current"),
        F.max(F.when(F.col("recency") == n, F.col("value"))).alias("first"),
    )
    delta = F.when(F.col("points") == n, F.col("current") - F.col("first"))
    return recent.select(*KEYS, "current", delta.alias("delta"), trend_label(delta).alias("trend"))


def _newest_in_task(n: int):
    """Cut the rows of one task to the newest n per metric, with the number of rows seen."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, seen = None, {}
        for batch in batches:
            for key, count in batch.groupby(list(KEYS)).size().items():
                seen[key] = seen.get(key, 0) + int(count)
            merged = batch if kept is None else pd.concat([kept, batch])
            kept = merged.sort_values(["ts", "step"]).groupby(list(KEYS), sort=False).tail(n)
        if kept is None or kept.empty:
            return
        kept = kept.copy()
        first = ~kept.duplicated(list(KEYS))
        kept["seen"] = [
            seen[key] if is_first else 0 for key, is_first in zip(zip(kept["run"], kept["metric"]), first)
        ]
        yield kept

    return cut


def stream_trend(points: DataFrame, n: int = TREND_POINTS) -> DataFrame:
    """``rolling_trend`` over a stream: the state of a metric is its newest n points and its number of points.

    Every task first cuts its rows to n per metric, so a busy metric does not pass through one task whole.
    """
    slim = points.select("run", "metric", "step", F.col("ts").cast("timestamp").alias("ts"), "value")
    reduced = slim.mapInPandas(
        _newest_in_task(n), "run string, metric string, step long, ts timestamp, value double, seen long"
    )

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, times, values, total = state.get if state.exists else ([], [], [], 0)
        rows = list(zip(times, steps, values))
        for batch in batches:
            total += int(batch["seen"].sum())
            rows += list(zip(batch["ts"].astype("int64") / 1e9, batch["step"], batch["value"]))
            rows = sorted(rows)[-n:]
        state.update(
            ([int(s) for _, s, _ in rows], [float(t) for t, _, _ in rows], [float(v) for _, _, v in rows], total)
        )
        current = float(rows[-1][2])
        delta = current - float(rows[0][2]) if len(rows) >= n else None
        label = "none" if delta is None else "flat" if abs(delta) < FLAT else "up" if delta > 0 else "down"
        yield pd.DataFrame(
            {
                "run": [key[0]],
                "metric": [key[1]],
                "points": [total],
                "current": [current],
                "delta": pd.Series([delta], dtype="float64"),
                "trend": [label],
            }
        )

    return reduced.groupBy(*KEYS).applyInPandasWithState(
        update, TREND_SCHEMA, _STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout
    )


def elapsed(points: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Seconds from the first to the last point."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = F.max(micros) - F.min(micros)
    return points.groupBy(*by).agg((seconds / 1e6).alias("elapsed_seconds"))


def throughput(points: DataFrame, every: str = "1 minute", seconds: float = 60.0, late: str | None = None) -> DataFrame:
    """Points per second in tumbling windows. A stream needs ``late``, the time late points are waited for."""
    points = points.withColumn("ts", F.col("ts").cast("timestamp"))
    if late is not None:
        points = points.withWatermark("ts", late)
    return (
        points.groupBy(F.window("ts", every).alias("w"))
        .agg(F.count("*").alias("points"))
        .select(F.col("w.start").alias("window_start"), "points", (F.col("points") / seconds).alias("per_second"))
    )


def eta_minutes(spent_seconds: Column, step: Column, start_step: Column, total_steps: Column) -> Column:
    """Whole minutes until the last step at the pace so far."""
    pace = spent_seconds / F.greatest(step - start_step, F.lit(1))
    return F.floor(pace * (total_steps - step) / 60)


def dataset_progress(results: DataFrame, totals: DataFrame) -> DataFrame:
    """Finished and expected samples and running accuracy per dataset; also over a stream, in update mode."""
    done = results.groupBy("dataset").agg(
        F.count("*").alias("completed"), F.avg(F.col("is_correct").cast("double")).alias("accuracy")
    )
    percent = F.when(F.col("total") > 0, F.col("completed") / F.col("total") * 100).otherwise(0.0)
    return done.join(totals, "dataset").select("dataset", "completed", "total", percent.alias("percent"), "accuracy")
