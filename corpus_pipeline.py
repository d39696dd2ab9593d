"""From raw documents to packed training sequences: five stages, each one of the operators of ``edulake.llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edulake.llm import decontaminate, line_dedup, packing, perplexity, simhash
from edulake.llm.textops import small_batches
from edulake.session import settle


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the perplexity bands reject go."""
    small_batches(spark)
    return perplexity.judge(docs).where("kept").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; ``n_chars`` follows the text. No document goes."""
    cleaned = line_dedup.drop_boilerplate(docs)
    changed = F.col("n_dropped") > 0
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.char_length("text")).otherwise(F.col("row.n_chars"))}
    kinds = dict(docs.dtypes)
    return cleaned.select(
        *[new[c].cast(kinds[c]).alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates stays: at five words about 0.8 or more of the shingles are shared."""
    small_batches(spark)
    return simhash.keep_one_similar(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.remove_contaminated(docs, _read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their ids, by sequence and offset."""
    small_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(docs, ranks, public_tokenizers.PATTERN, added=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_items),
    ("packing", pack_sequences),
]

#: SQL has no such fingerprints, tokenisers or packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is settled as a table before the next reads it."""
    docs = _read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
