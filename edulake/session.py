"""Session helpers: settling results in the shared folder, and joins that keep nulls."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTLED: list[str] = []
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder named by ``spark.checkpoint.dir``; in local mode an unset folder lies in the warehouse."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/settled"
    context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Later passes read the result and not its lineage, also after executors are lost. As a table of known size the
    result is broadcast by Spark where it is small, and where it is not, adaptive execution can split skewed
    partitions, which it cannot while an aggregation stands between shuffle and join.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SETTLED.append(path)
    settled = spark.read.schema(df.schema).parquet(path)
    _PATHS[settled] = path
    return settled


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Delete tables as ``settle`` gave them, once all that rests on them is settled itself or written."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path in _SETTLED:
            _SETTLED.remove(path)
            _delete(table.sparkSession, path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Let Spark delete a query's shuffle files as soon as it ends, inside the block.

    Otherwise they stay until the driver collects its garbage. Whoever settles each step reads no shuffle twice.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release_settled(spark: SparkSession, since: int = 0) -> int:
    """Delete what this process has settled, once all results that rest on it are written. Gives the number.

    ``since`` leaves the first so many tables alone.
    """
    count = 0
    while len(_SETTLED) > since:
        _delete(spark, _SETTLED.pop())
        count += 1
    return count


@contextmanager
def settled_within(spark: SparkSession) -> Iterator[None]:
    """Delete, on leaving the block, what was settled inside it. Write results that rest on it before."""
    before = len(_SETTLED)
    try:
        yield
    finally:
        release_settled(spark, before)


def join_with_nulls(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null. The key columns are those of ``left``.

    Settled sides carry their size, so Spark broadcasts the small ones and splits the skewed partitions of others.
    """
    renamed = right.select(*[F.col(c).alias(f"__right_{c}" if c in keys else c) for c in right.columns])
    matched = F.lit(True)
    for key in keys:
        matched = matched & left[key].eqNullSafe(F.col(f"__right_{key}"))
    return left.join(renamed, matched, how).drop(*[f"__right_{key}" for key in keys])
