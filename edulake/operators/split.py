"""Holdout splits and the checks that belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edulake.functions.bloom import BloomFilter
from edulake.operators.ranking import first_per_group, lowest_cut, with_lowest_mark
from edulake.session import settle

MIN_EVAL = 10
MIN_TRAIN = 10


def holdout_size(total, ratio, cap):
    """Rows to hold out: the ratio up to the cap, at least ten, and at least ten left for training."""
    wanted = F.least(F.floor(total * ratio), cap)
    return F.least(F.greatest(wanted, F.lit(MIN_EVAL)), total - MIN_TRAIN)


def holdout_split(
    df: DataFrame,
    key: str,
    dataset: str = "dataset",
    ratio: float = 0.05,
    cap: int = 500,
    seed: str = "42",
    group_key: str | None = None,
    settings: DataFrame | None = None,
) -> DataFrame:
    """Give every row ``split`` = ``eval`` or ``train``, with an exact number of eval rows per dataset.

    ``settings`` may carry ``eval_ratio`` and ``eval_cap`` per dataset; ``ratio`` and ``cap`` hold for those it leaves
    out. Every row comes back, also of a null dataset; of a repeated key as many rows as the number needs. With ``group_key`` whole groups are
    drawn, so copies of one question never end up on both sides, and the number counts groups. Datasets of
    fewer than ten rows cannot be split and are refused. An existing ``split`` column is kept.
    """
    unit_key = group_key or key
    units = df.select(dataset, unit_key)
    if group_key:
        units = units.distinct()

    def quota(total):
        if settings is None:
            return holdout_size(total, F.lit(ratio), F.lit(cap))
        return holdout_size(
            total, F.coalesce("eval_ratio", F.lit(ratio)), F.coalesce("eval_cap", F.lit(cap))
        )

    cut = lowest_cut(units, [dataset], unit_key, seed, quota, settings)
    small = cut.where(F.col("total") < MIN_TRAIN).select(dataset).head(5)
    if small:
        raise ValueError(f"too few rows to split: {[row[0] for row in small]}")
    marked = with_lowest_mark(df, [dataset], unit_key, seed, cut, "__eval")
    if "split" in df.columns:
        return marked.drop("__eval")
    return marked.withColumn("split", F.when(F.col("__eval"), "eval").otherwise("train")).drop("__eval")


def train_rows(df: DataFrame, eval_rows: DataFrame, key: str) -> DataFrame:
    """All rows whose key is not held out. Held-out keys are few, so the rows stay where they are."""
    return df.join(settle(eval_rows.select(key)), key, "left_anti")


def _among(rows: DataFrame, key: Column, few: DataFrame, name: str) -> DataFrame:
    """The rows whose ``key`` is in the settled table ``few``. What its Bloom filter stops is neither joined nor shuffled."""
    keyed = rows.withColumn("__key", key)
    passed = keyed.where(BloomFilter(few, name).might_contain(F.col("__key")))
    return passed.join(few, F.col("__key").eqNullSafe(few[name]), "left_semi").drop("__key")


def leaked_prefixes(df: DataFrame, question: str = "question", chars: int = 100) -> DataFrame:
    """Distinct question prefixes that occur in both splits.

    The held-out prefixes are few. A Bloom filter of them stops nearly all training rows where they are read; what passes
    is looked up exactly, so nothing is missed and nothing wrong is found.
    """
    prefix = F.substring(question, 1, chars)
    held = settle(df.where("split = 'eval'").select(prefix.alias("prefix")).distinct())
    trained = df.where("split = 'train'").select(prefix.alias("prefix"))
    return _among(trained, F.col("prefix"), held, "prefix").distinct()


def leaked_rows(df: DataFrame, question: str = "question", chars: int = 100) -> DataFrame:
    """Rows whose question prefix occurs in both splits."""
    leaked = settle(leaked_prefixes(df, question, chars).where("prefix IS NOT NULL"))
    prefix = F.substring(question, 1, chars)
    return _among(df.withColumn("prefix", prefix), F.col("prefix"), leaked, "prefix")


def config_overlap(evaluated: DataFrame, trained: DataFrame) -> DataFrame:
    """Evaluation configs that are also training configs of the same split."""
    return evaluated.join(trained, ["dataset", "config", "split"], "left_semi")


def raw_sample_cap(df: DataFrame, key: str, dataset: str = "dataset", n: int = 100) -> DataFrame:
    """The first n rows of every dataset. Null datasets are one dataset, and of equal keys any rows are taken.

    Parts of a dataset are cut to n rows each before they meet, so one dataset of many rows never meets in one task.
    """
    return first_per_group(df, [dataset], [F.col(key)], n).drop("__rn")
