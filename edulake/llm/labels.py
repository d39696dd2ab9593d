"""Labelled rows of documents: the folds that the classifiers learn from and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edulake.session import settle


def held_out(id: Column) -> Column:
    """True for rows that no classifier learns from: remainder 1 of three by checksum of the id, and null ids."""
    return F.coalesce(F.crc32(id.cast("string")) % 3 == 1, F.lit(True))


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    most: int,
    id: str = "doc_id",
    text: str = "text",
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """``__id``, ``label`` (0 or 1), ``extra`` columns of the document and ``__text`` of at most ``most`` labelled rows that are not held out.

    Where there are more, those with the smallest hashes of their ids are taken, so the sample depends neither on the
    order nor on the partitions. Null labels and null texts teach nothing. Its bound makes the sample safe to broadcast.
    """
    own = labels.select(F.col(id).alias("__id"), F.col(label).cast("int").alias("label"))
    own = own.where(F.col("label").isin(0, 1) & ~held_out(F.col("__id")))
    sample = settle(own.orderBy(F.xxhash64("__id"), "__id", "label").limit(most))
    more = [column.alias(name) for name, column in (extra or {}).items()]
    rows = docs.select(F.col(id).alias("__id"), F.col(text).cast("string").alias("__text"), *more)
    rows = rows.where("__text IS NOT NULL")
    return rows.join(F.broadcast(sample), "__id").select("__id", "label", *(extra or {}), "__text")
