"""Image files read where they are needed: names meet rows, and bytes go from the file into the row's own task.

A listing costs no content, so rows find out by name which files exist. The rows that stay are dealt out by ranges of
the path, as many as the files' bytes deserve, and each task then opens its own files. No exchange carries bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of files for one task, and those that one batch of rows carries at most, but for a single larger file.
TASK_BYTES = 128 << 20
BATCH_BYTES = 16 << 20
#: File systems that tasks open by themselves; those of others are read by Spark (``images.resolve_images``).
SCHEMES = {"": "file", "file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    parts = urlsplit(path, allow_fragments=False)
    scheme = SCHEMES.get(parts.scheme)
    if scheme is None:
        raise ValueError(f"tasks cannot open files of {parts.scheme!r}; resolve them by images.resolve_images")
    if scheme == "file":
        return fs.LocalFileSystem(), path.removeprefix(f"{parts.scheme}:").removeprefix("//") if parts.scheme else path
    if scheme == "hdfs" or scheme == "viewfs":
        return fs.HadoopFileSystem.from_uri(f"{scheme}://{parts.netloc}"), parts.path
    own, _ = fs.FileSystem.from_uri(f"{scheme}://{parts.netloc}{parts.path}")
    return own, f"{parts.netloc}{parts.path}"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` relative to the root, ``file`` and ``length`` of all files below it that are not empty. Their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = F.substring_index("path", root.rstrip("/") + "/", -1)
    return files.select(tail.alias("path"), F.col("path").alias("file"), "length")


def _contents(names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(batch: pa.RecordBatch, first: int, found: list[bytes]) -> pa.RecordBatch:
            kept = batch.slice(first, len(found))
            return pa.RecordBatch.from_arrays(
                [*(kept.column(n) for n in names), pa.array(found, pa.binary())], [*names, "content"]
            )

        for batch in batches:
            first, found, size = 0, [], 0
            for file in batch.column("__file").to_pylist():
                system, path = opened(file)
                with system.open_input_stream(path) as stream:
                    found.append(stream.read())
                size += len(found[-1])
                if size >= BATCH_BYTES:
                    yield finished(batch, first, found)
                    first, found, size = first + len(found), [], 0
            if found:
                yield finished(batch, first, found)

    return run


def attach_contents(rows: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """The rows whose ``path`` is among ``files``, with the file's ``content``. Rows whose file is missing are left out.

    A file that several rows name is opened for each of them. A file that vanishes meanwhile fails its task.
    """
    known = files.select(F.col("path").alias("__path"), F.col("file").alias("__file"), F.col("length").alias("__length"))
    met = rows.join(known, F.col(path) == F.col("__path")).drop("__path")
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // TASK_BYTES), rows.sparkSession.sparkContext.defaultParallelism)
    dealt = met.repartitionByRange(int(tasks), "__file").select(*rows.columns, "__file")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return dealt.mapInArrow(_contents(rows.columns), f"{kinds}, content binary")


def write_files(df: DataFrame, root: str) -> int:
    """Write every row's ``content`` to ``path`` below the root, from the tasks that hold the rows. Gives their number.

    A task that runs again writes the same files again.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[str] = set()
        count = 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                system, target = opened(f"{root.rstrip('/')}/{path}")
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(target) as stream:
                    stream.write(content or b"")
                count += 1
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["n"])

    return df.select("path", "content").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
