"""Queries of the operators over the given tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edulake.llm import (
    boosting,
    ctw,
    decontaminate,
    hard_negatives,
    line_dedup,
    packing,
    perplexity,
    pii,
    resharding,
    simhash,
    spelling,
    toxicity,
    wrapper,
)
from edulake.llm.textops import small_batches

#: The key of the surrogates in the query. Whoever keeps it secret keeps the surrogates from being undone by trial.
PII_KEY = "surrogates-1"

#: The shards that documents lie in, by source, before they are dealt out anew, and the shards after.
OLD_SHARDS, SHARDS = 12, 16

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL where there is any."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_simhash_near_dedup")
def near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op2_line_dedup", line_dedup.SQL)
def lines(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(table(spark, folder, "documents"))
    return cleaned.select("row.doc_id", "text", "n_lines", "n_dropped")


@query("op4_decontaminate", decontaminate.SQL)
def contaminations(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_packing")
def packed(spark: SparkSession, folder: str) -> DataFrame:
    # The ranks hold the same merges as byte_bpe_50k.json, and give the same ids faster; the JSON has the added tokens.
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    added = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, added=added)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op7_quality_rules")
def rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = perplexity.judge(table(spark, folder, "documents"), keep=["doc_id"])
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "log_perplexity",
        "lower",
        "upper",
    )


@query("op5_quality_classifier")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    return boosting.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_toxicity")
def toxic(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_context_tree_scores")
def scores(spark: SparkSession, folder: str) -> DataFrame:
    return ctw.score(table(spark, folder, "documents"))


@query("op10_html_extraction")
def main_texts(spark: SparkSession, folder: str) -> DataFrame:
    return wrapper.extract(table(spark, folder, "pages"), keep=["page_id", "url"])


@query("op8_pii_surrogates")
def private(spark: SparkSession, folder: str) -> DataFrame:
    replaced = pii.replace_personal_data(table(spark, folder, "documents"), PII_KEY)
    return replaced.select("row.doc_id", "text", "n_replaced")


@query("op11_spelling_variants")
def spellings(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling.vocabulary(table(spark, folder, "documents"))
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_min_cost_resharding")
def shards(spark: SparkSession, folder: str) -> DataFrame:
    old = F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(OLD_SHARDS))
    dealt = resharding.shard_documents(table(spark, folder, "documents"), old, SHARDS)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
        "moved",
    )


@query("op13_hard_negatives", hard_negatives.SQL)
def negatives(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    finite = F.transform("embedding", lambda x: F.when(F.abs(x) < float("inf"), 1))
    vector = F.when(F.forall(finite, lambda x: x.isNotNull()), whole)
    rows = found.select(F.col("vec_id").alias("id"), label.alias("label"), vector.alias("vector"))
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)
