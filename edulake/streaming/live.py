"""Stateful live views: the newest points of a metric, elapsed time and time left of a run, and progress counted once.

The state of a metric or run has a fixed size, tasks cut their rows to what can matter before these meet, and runs that
have gone silent leave the state. A micro-batch that is repeated finds the state it began with, so it gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from edulake.streaming.metrics import HISTORY_POINTS, KEYS, dataset_progress

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_POINTS = "run string, metric string, step long, micros long, value double"
HISTORY_SCHEMA = "run string, metric string, step long, micros long, value double, recency long"
PROGRESS_SCHEMA = "run string, elapsed_seconds double, step long, eta_minutes long, finished boolean"


def use_state_store(spark: SparkSession) -> None:
    """Keep the state of the session's streams in the store that lists, values and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


# -- bounded history ---------------------------------------------------------------------------------------


def _merged(rows: list[tuple], n: int) -> list[tuple]:
    """The newest n distinct points, oldest first; without values, which may be NaN, in the order."""
    return sorted({(m, s): (m, s, v) for m, s, v in rows}.values(), key=lambda r: r[:2])[-n:]


def _newest_points(n: int):
    """Cut the rows of one task to the newest n per metric."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            merged = batch if kept is None else pd.concat([kept, batch])
            kept = merged.sort_values(["micros", "step"]).groupby(list(KEYS), sort=False, dropna=False).tail(n)
        if kept is not None:
            yield kept

    return cut


class _History(StatefulProcessor):
    """The newest points of one metric as list state, oldest first."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getListState("points", "micros long, step long, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.points.get()] if self.points.exists() else []
        for batch in rows:
            new = zip(batch["micros"].tolist(), batch["step"].tolist(), batch["value"].tolist(), strict=True)
            # A point that came late takes the place its time gives it, or none among the newest.
            held = _merged([*held, *new], self.n)
        self.points.put(held)
        count = len(held)
        yield pd.DataFrame(
            {
                "run": [key[0]] * count,
                "metric": [key[1]] * count,
                "step": [s for _, s, _ in held],
                "micros": [m for m, _, _ in held],
                "value": [v for _, _, v in held],
                "recency": list(range(count, 0, -1)),
            }
        )

    def close(self) -> None:
        pass


def stream_history(points: DataFrame, n: int = HISTORY_POINTS) -> DataFrame:
    """``bounded_history`` over a stream: each micro-batch gives the whole newest history of the metrics it touches.

    A point delivered twice, with the same time and step, counts once. State: n points a metric.
    """
    slim = points.select("run", "metric", "step", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "value")
    cut = slim.mapInPandas(_newest_points(n), _POINTS)
    found = cut.groupBy(*KEYS).transformWithStateInPandas(_History(n), HISTORY_SCHEMA, "Update", "None")
    return found.withColumn("ts", F.timestamp_micros("micros")).drop("micros")


# -- elapsed time and time left ----------------------------------------------------------------------------


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the rows of one task the first and the last time and step of every run."""
    kept = None
    for batch in batches:
        found = batch.groupby("run", as_index=False, dropna=False).agg(
            first=("ts", "min"), ts=("ts", "max"), least=("step", "min"), most=("step", "max")
        )
        if kept is not None:
            found = pd.concat([kept, found]).groupby("run", as_index=False, dropna=False).agg(
                first=("first", "min"), ts=("ts", "max"), least=("least", "min"), most=("most", "max")
            )
        kept = found
    if kept is not None:
        yield kept


class _Progress(StatefulProcessor):
    """First and last time and step of one run as value state; a timer behind the last point lets a silent run go."""

    def __init__(self, total_steps: int, silent_ms: int):
        self.total_steps, self.silent_ms = total_steps, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "first long, last long, least long, most long")

    def _row(self, key, state: tuple, finished: bool) -> pd.DataFrame:
        first, last, least, most = state
        spent = (last - first) / 1e6
        left = spent / max(most - least, 1) * (self.total_steps - most) / 60
        return pd.DataFrame(
            {
                "run": [key[0]],
                "elapsed_seconds": [spent],
                "step": [most],
                "eta_minutes": [int(left // 1)],
                "finished": [finished],
            }
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.ends.get()) if self.ends.exists() else None
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        for batch in rows:
            micros = [batch[c].astype("datetime64[us]").astype("int64").tolist() for c in ("first", "ts")]
            for first, last, least, most in zip(*micros, batch["least"].tolist(), batch["most"].tolist(), strict=True):
                if state is None:
                    # The run has left, or begins so late that it would leave at once.
                    if last + self.silent_ms * 1000 <= watermark:
                        continue
                    state = first, last, least, most
                else:
                    state = min(state[0], first), max(state[1], last), min(state[2], least), max(state[3], most)
        if state is None:
            return
        self.ends.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(state[1] // 1000 + self.silent_ms)
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.ends.exists():
            state = tuple(self.ends.get())
            self.ends.clear()
            yield self._row(key, state, True)

    def close(self) -> None:
        pass


def stream_run_progress(
    points: DataFrame, total_steps: int, late: str = "10 minutes", silent_seconds: float = 3600.0
) -> DataFrame:
    """``elapsed`` and ``eta_minutes`` of every run over a stream, in update mode.

    A run without points for ``silent_seconds`` of event time, counted when the watermark (``late``) has passed them, is
    given once more as ``finished`` and leaves the state; a point that comes later still does not bring it back.
    """
    slim = points.select("run", "step", F.col("ts").cast("timestamp").alias("ts"))
    cut = slim.mapInPandas(_ends, "run string, first timestamp, ts timestamp, least long, most long")
    return (
        cut.withWatermark("ts", late)
        .groupBy("run")
        .transformWithStateInPandas(
            _Progress(total_steps, int(silent_seconds * 1000)), PROGRESS_SCHEMA, "Update", "EventTime"
        )
    )


# -- progress counted once ---------------------------------------------------------------------------------


def distinct_results(results: DataFrame, late: str = "1 hour") -> DataFrame:
    """Every sample's result once, however often it is delivered within ``late`` of its first delivery."""
    stamped = results.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", late).dropDuplicatesWithinWatermark(["dataset", "sample_id"])


def stream_progress(results: DataFrame, totals: DataFrame, late: str = "1 hour") -> DataFrame:
    """``dataset_progress`` over a stream whose results (``dataset``, ``sample_id``, ``ts``, ``is_correct``) may repeat."""
    return dataset_progress(distinct_results(results, late), totals)


def stream_counts(results: DataFrame, late: str = "1 hour") -> DataFrame:
    """Finished samples and running accuracy per dataset over a stream, without totals."""
    return (
        distinct_results(results, late)
        .groupBy("dataset")
        .agg(F.count("*").alias("completed"), F.avg(F.col("is_correct").cast("double")).alias("accuracy"))
    )


def with_totals(write: Callable[[DataFrame, int], None], read_totals: Callable[[], DataFrame]) -> Callable:
    """A ``foreachBatch`` function that joins ``stream_counts`` with the totals as they are when the batch is written."""

    def run(batch: DataFrame, number: int) -> None:
        done = F.when(F.col("total") > 0, F.col("completed") / F.col("total") * 100).otherwise(0.0)
        joined = batch.join(read_totals(), "dataset")
        write(joined.select("dataset", "completed", "total", done.alias("percent"), "accuracy"), number)

    return run
