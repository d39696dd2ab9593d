"""Reading and writing samples."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edulake.operators.chat import parse_turns
from edulake.schema import SAMPLE, SAMPLE_ATTRIBUTES
from edulake.session import settle


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of one Parquet dataset with whatever optional attributes it carries."""
    stored = spark.read.parquet(path)
    known = {f.name for f in (*SAMPLE.fields, *SAMPLE_ATTRIBUTES.fields)}
    missing = [f.name for f in SAMPLE.fields if f.name not in stored.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    types = {f.name: f.dataType for f in (*SAMPLE.fields, *SAMPLE_ATTRIBUTES.fields)}
    return stored.select(*[F.col(c).cast(types[c]) if c in known else F.col(c) for c in stored.columns])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists on the file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_datasets(spark: SparkSession, paths: str | Mapping[str, str]) -> tuple[DataFrame | None, list[str]]:
    """Union of all datasets whose path exists, with a ``dataset`` column, and the names that were skipped.

    ``paths`` maps names to paths, or is a comma-separated list whose paths serve as names.
    """
    if isinstance(paths, str):
        paths = {p.strip(): p.strip() for p in paths.split(",") if p.strip()}
    merged, skipped = None, []
    for name, path in paths.items():
        if not path_exists(spark, path):
            skipped.append(name)
            continue
        part = read_samples(spark, path).withColumn("dataset", F.lit(name))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    return merged, skipped


def dataset_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("dataset").agg(F.count("*").alias("rows"))


def concat_same_schema(frames: Iterable[DataFrame]) -> DataFrame:
    """Union of tables of one schema; any other schema is refused."""
    frames = list(frames)
    first = frames[0]
    names = [(f.name, f.dataType) for f in first.schema.fields]
    merged = first
    for frame in frames[1:]:
        if [(f.name, f.dataType) for f in frame.schema.fields] != names:
            raise ValueError(f"schemas differ: {first.schema.simpleString()} and {frame.schema.simpleString()}")
        merged = merged.unionByName(frame)
    return merged


def write_samples(
    samples: DataFrame, path: str, partition_by: Iterable[str] = ("dataset",), mode: str = "error"
) -> None:
    """Snappy Parquet. Optional columns are kept, partition columns become folders."""
    columns = [c for c in partition_by if c in samples.columns]
    samples.write.mode(mode).option("compression", "snappy").partitionBy(*columns).parquet(path)


def write_if_absent(samples: DataFrame, path: str, partition_by: Iterable[str] = ("dataset",)) -> None:
    """Write only when there is nothing at the path yet; existing output counts as success."""
    write_samples(samples, path, partition_by, mode="ignore")


def append_missing_datasets(samples: DataFrame, path: str) -> None:
    """Add the datasets that the output does not hold yet."""
    spark = samples.sparkSession
    if path_exists(spark, path):
        # Only the partition column is read, which comes from folder names.
        have = settle(spark.read.parquet(path).select("dataset").distinct())
        samples = samples.join(have, "dataset", "left_anti")
    write_samples(samples, path, mode="append")


def preview(samples: DataFrame, n: int = 2, chars: int = 60) -> DataFrame:
    """The first rows with every turn cut to a line."""

    def line(turn: Column) -> Column:
        return F.concat(
            turn["role"], F.lit(": "), F.replace(F.substring(turn["content"], 1, chars), F.lit("\n"), F.lit(" "))
        )

    turns = parse_turns(F.col("conversations"))
    order = ["row_id"] if "row_id" in samples.columns else []
    rows = samples.orderBy(*order) if order else samples
    return rows.limit(n).select(*order, F.array_join(F.transform(turns, line), " | ").alias("preview"))


def empty_samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType(SAMPLE.fields))
