"""Conversations in JSON arrays, and the image files they name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edulake.schema import SOURCE_CONVERSATION
from edulake.session import settle
from edulake.sources.image_files import attach_contents
from edulake.sources.json_array import read_objects

# ---- Fixed values: folder of every image key. ----
IMAGE_FOLDERS = (
    ("Docmatix", "Docmatix"),
    ("Tallyqa", "Tallyqa"),
    ("PlotQA", "PlotQA"),
    ("geo170k", "data/local/Open-source-data/geo170k"),
    ("EST_VQA", "EST_VQA"),
    ("arxivqa", "arxivqa"),
)
# ---- End of fixed values. ----


def read_conversation_array(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of files that hold one JSON array each, with the name of the file they came from. Large files are split."""
    objects = read_objects(spark, path)
    rows = objects.select(F.from_json("json", SOURCE_CONVERSATION).alias("row"), F.col("file_name").alias("json_file"))
    return rows.select("row.*", "json_file")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """``path`` relative to the root, and ``content``, of all files below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = F.substring_index("path", root.rstrip("/") + "/", -1)
    return files.select(tail.alias("path"), "content")


def folder_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(IMAGE_FOLDERS, "folder_key string, folder string")


def _named(df: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows with the ``path`` of their first image.

    A few keys hold all rows, so a shuffle on the key would put them into as many tasks. The folders are settled: as a
    table of known size they are sent to the rows.
    """
    named = df.join(settle(folders).withColumnRenamed("folder_key", "image_file"), "image_file", "left")
    path = F.concat_ws("/", F.nullif(F.coalesce("folder", "image_file"), F.lit("")), F.get("image", F.lit(0)))
    return named.withColumn("path", path)


def resolve_images(df: DataFrame, images: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows whose first image exists, with its ``content``. Rows meet files on the path.

    ``images`` is the result of ``read_images``, whose bytes are joined, or of ``image_files.list_files``, whose bytes
    are read only for the rows that stay.
    """
    named = _named(df, folders)
    if "content" in images.columns:
        return named.join(images, "path")
    return attach_contents(named, images)
