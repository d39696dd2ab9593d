"""Registry of queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import DUCKDB_VIEWS, SPREAD, STORED, VIEWS
from edulake.session import ensure_checkpoint_dir, settle

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
_NAME = re.compile(r"@(\w+)")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer partitions than cores before CPU-heavy row work.

    A table of many files has more partitions than cores, and is then left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


class Tables:
    """The given tables of one folder, and views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in TABLES:
                self._cache[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in VIEWS:
                sql = VIEWS[name].replace("$list(", "array(")
                used = set(_NAME.findall(sql))
                inputs = {u: getattr(self, u) for u in used}
                if name in SPREAD:
                    inputs = {u: spread(df) for u, df in inputs.items()}
                view = self.spark.sql(_NAME.sub(r"{\1}", sql), **inputs)
                self._cache[name] = settle(view) if name in STORED else view
            else:
                raise AttributeError(name)
        return self._cache[name]

    @cached_property
    def scratch(self) -> str:
        """A new folder beside the checkpoints, for queries that write and read back."""
        return f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def duckdb_view(name: str) -> str:
    return (DUCKDB_VIEWS.get(name) or VIEWS[name]).replace("$list(", "list_value(")


def oracle(body: str) -> str:
    """Prefix the views that a body names as ``@view``, and strip the marks."""
    order: list[str] = []

    def need(sql: str) -> None:
        for name in _NAME.findall(sql):
            if name in TABLES or name in order:
                continue
            need(duckdb_view(name))
            if name not in order:
                order.append(name)

    need(body)
    views = [f"{name} AS ({_NAME.sub(r'\1', duckdb_view(name))})" for name in order]
    body = _NAME.sub(r"\1", body.strip())
    if not views:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join(views) + ", " + body[5:]
    return "WITH " + ", ".join(views) + " " + body


def query(
    name: str,
    sql: str | None,
    doubles: Sequence[str] = (),
    longs: Sequence[str] = (),
    digits: int = 9,
):
    """Register a query. Doubles are rounded and whole numbers widened on both sides before they are compared."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = fn(Tables(spark, folder))
            for column in doubles:
                df = df.withColumn(column, F.round(F.col(column).cast("double"), digits) + F.lit(0.0))
            for column in longs:
                df = df.withColumn(column, F.col(column).cast("bigint"))
            return df

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            casts = [f"round(CAST({c} AS DOUBLE), {digits}) + 0.0::DOUBLE AS {c}" for c in doubles]
            casts += [f"CAST({c} AS BIGINT) AS {c}" for c in longs]
            text = oracle(sql)
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({text})" if casts else text
        return fn

    return register
