"""Bootstrap intervals and tests on per-sample scores, by one method for groups of any size.

Scores are reduced to a histogram per group. In every replicate a histogram row that stands for c samples gets a Poisson
count of mean c, which is what c samples drawn with replacement come to. A task keeps for its group one vector with the
counts of all replicates and one with their weighted sums, and hands on only these: what is shuffled is two numbers per
task, group and replicate, however many scores there are. The counts come from portable hashes of group, value and
replicate, so they are the same on every engine and retry, and wherever a row is worked on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edulake.functions import poisson
from edulake.functions.hashing import hash52
from edulake.functions.numeric import round_exact
from edulake.schema import METRICS
from edulake.session import join_with_nulls

REPLICATES = 1000
MIN_ROWS = 5
MIN_ATTACHED = 10
#: Histogram rows whose counts are drawn at once: a few megabytes for a thousand replicates.
ROWS_AT_ONCE = 256
#: Parts that the vectors of a group are cut into, so that they are added up by several tasks.
BLOCKS = 8


def _units(count: Column) -> Column:
    """The units of all digits of a count, as an array of (place, j)."""

    def units(place: int) -> Column:
        digit = F.shiftright(count, poisson.BASE_BITS * place)
        if place < poisson.PLACES - 1:
            digit = digit.bitwiseAND(F.lit(poisson.BASE - 1).cast("bigint"))
        numbers = F.sequence(F.lit(0).cast("bigint"), F.greatest(digit, F.lit(1)) - 1)
        numbers = F.when(digit > 0, numbers).otherwise(F.array().cast("array<bigint>"))
        return F.transform(numbers, lambda j: F.struct(F.lit(place).alias("place"), j.alias("j")))

    return F.flatten(F.array(*[units(place) for place in range(poisson.PLACES)]))


def _starts(batch: pa.RecordBatch, by: Sequence[str]) -> np.ndarray:
    """The rows at which a group begins, where equal groups lie side by side."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[:1] = True
    for name in by:
        codes = pc.dictionary_encode(batch.column(name), null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _vectors(by: Sequence[str], replicates: int) -> Callable[[Iterable], Iterator]:
    columns = np.arange(replicates)
    edges = np.linspace(0, replicates, BLOCKS + 1).astype(int)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key, n, weights, sums = None, None, 0, None, None

        def finished() -> pa.RecordBatch:
            lists = [
                pa.array([v[a:b] for a, b in zip(edges[:-1], edges[1:])], pa.list_(pa.float64()))  # noqa: B905
                for v in (weights, sums)
            ]
            first = [group.column(c).take(pa.array([0] * BLOCKS)) for c in by]
            own = [pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array([n] * BLOCKS, pa.int64())]
            return pa.RecordBatch.from_arrays([*first, *own, *lists], [*by, "block", "n", "w", "s"])

        for batch in batches:
            starts = _starts(batch, by)
            values, seeds, places, samples = (batch.column(c).to_numpy() for c in ("value", "seed", "place", "samples"))
            for first, last in zip(starts, [*starts[1:], batch.num_rows]):  # noqa: B905
                head = batch.slice(first, 1)
                new = tuple(head.column(c)[0].as_py() for c in by)
                if group is None or new != key:
                    if group is not None:
                        yield finished()
                    group, key, n = head, new, 0
                    weights, sums = np.zeros(replicates), np.zeros(replicates)
                n += int(samples[first:last].sum())
                for place in np.unique(places[first:last]):
                    rows = first + np.flatnonzero(places[first:last] == place)
                    for k in range(0, len(rows), ROWS_AT_ONCE):
                        some = rows[k : k + ROWS_AT_ONCE]
                        drawn = poisson.counts(seeds[some], columns, poisson.BASE ** int(place))
                        weights += drawn.sum(axis=0)
                        sums += values[some] @ drawn
        if group is not None:
            yield finished()

    return run


def _added_up(by: Sequence[str], replicates: int) -> Callable[[pa.Table], pa.Table]:
    edges = np.linspace(0, replicates, BLOCKS + 1).astype(int)

    def run(parts: pa.Table) -> pa.Table:
        block = parts.column("block")[0].as_py()
        numbers = np.arange(edges[block], edges[block + 1])
        weights, sums = (
            np.asarray(parts.column(c).combine_chunks().flatten()).reshape(parts.num_rows, -1).sum(axis=0)
            for c in ("w", "s")
        )
        n = pc.sum(parts.column("n")).as_py()
        with np.errstate(invalid="ignore", divide="ignore"):
            means = pa.array(sums / weights, mask=weights == 0)
        same = pa.array(np.zeros(len(numbers), dtype=np.int64))
        first = [parts.column(c).combine_chunks().take(same) for c in by]
        return pa.table(
            [*first, pa.array([n] * len(numbers), pa.int64()), pa.array(numbers, pa.int32()), means],
            [*by, "n", "b", "mean"],
        )

    return run


def resample_means(df: DataFrame, by: Sequence[str], value: str, replicates: int = REPLICATES) -> DataFrame:
    """One row per group and replicate: the mean of a resample; null where a replicate holds no sample.

    Null scores take no part. Drawing takes a thousand times longer than reading, so the histogram is dealt out over all
    tasks whatever its bytes, the rows of one value as well.
    """
    by = list(by)
    spark = df.sparkSession
    scores = df.select(*by, F.col(value).cast("double").alias("value")).where("value IS NOT NULL")
    hist = scores.groupBy(*by, "value").agg(F.count("*").alias("cnt"))
    floor = F.floor("value")
    name = [*[F.col(c) for c in by], floor, F.floor((F.col("value") - floor) * F.lit(1e9)), F.col("place"), F.col("j")]
    pieces = (
        hist.select("*", F.explode(_units(F.col("cnt"))).alias("u"))
        .select(*by, "value", "cnt", "u.place", "u.j")
        .withColumn("seed", hash52(*name).bitwiseAND(F.lit(poisson.MASK).cast("bigint")))
        .withColumn("samples", F.pow(F.lit(float(poisson.BASE)), F.col("place")).cast("bigint"))
        .select(*by, "value", "seed", "place", "samples")
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = pieces.repartition(tasks, "seed", "place").sortWithinPartitions(*by)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    vectors = dealt.mapInArrow(_vectors(by, replicates), f"{kinds}, block int, n bigint, w array<double>, s array<double>")
    return vectors.groupBy(*by, "block").applyInArrow(
        _added_up(by, replicates), f"{kinds}, n bigint, b int, mean double"
    )


def long_scores(df: DataFrame, ids: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per score; missing scores are left out."""
    return (
        df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
        .unpivot(list(ids), list(metrics), "metric", "value")
        .where("value is not null")
    )


def confidence_intervals(
    scores: DataFrame,
    by: Sequence[str] = ("dataset", "metric"),
    value: str = "value",
    confidence: float = 0.95,
    replicates: int = REPLICATES,
) -> DataFrame:
    """Bootstrap interval of the mean and the share of resample means at or below 0, at least 1/replicates.

    Groups of fewer than five rows get the interval (0, 0) and p = 1.
    """
    alpha = 1 - confidence
    means = resample_means(scores, by, value, replicates)
    result = means.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.percentile("mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"),
        F.avg((F.col("mean") <= 0).cast("double")).alias("p"),
    )
    enough = F.col("n") >= MIN_ROWS
    return result.select(
        *by,
        "n",
        F.when(enough, F.col("q")[0]).otherwise(0.0).alias("lower"),
        F.when(enough, F.col("q")[1]).otherwise(0.0).alias("upper"),
        F.when(enough, F.greatest(F.col("p"), F.lit(1.0 / replicates))).otherwise(1.0).alias("p_value"),
    )


def attached_intervals(intervals: DataFrame) -> DataFrame:
    """The intervals a run record carries: groups of at least ten rows, four decimals."""
    rounded = [round_exact(F.col(c), 4).alias(c) for c in ("lower", "upper", "p_value")]
    others = [c for c in intervals.columns if c not in ("lower", "upper", "p_value")]
    return intervals.where(F.col("n") >= MIN_ATTACHED).select(*others, *rounded)


def paired_p_value(
    first: DataFrame,
    second: DataFrame,
    by: Sequence[str] = ("dataset",),
    key: str = "sample_id",
    value: str = "value",
    replicates: int = REPLICATES,
) -> DataFrame:
    """Share of paired resamples in which the second run is not better than the first.

    A group whose two runs do not hold the same samples gets p = 1.
    """
    by = list(by)
    left = first.select(*by, key, F.col(value).cast("double").alias("a"))
    right = second.select(*by, key, F.col(value).cast("double").alias("b_"))
    pairs = left.join(right, [*by, key], "full_outer").withColumn("diff", F.col("b_") - F.col("a"))
    status = pairs.groupBy(*by).agg(F.count_if(F.col("diff").isNull()).alias("unpaired"))
    tested = resample_means(pairs.where("diff is not null"), by, "diff", replicates)
    p = tested.groupBy(*by).agg(F.avg((F.col("mean") <= 0).cast("double")).alias("p"), F.max("n").alias("n"))
    usable = (F.col("unpaired") == 0) & F.col("p").isNotNull()
    return join_with_nulls(status, p, by, "left").select(
        *by,
        F.coalesce("n", F.lit(0)).alias("n"),
        F.when(usable, F.col("p")).otherwise(1.0).alias("p_value"),
    )
