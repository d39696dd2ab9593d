"""From raw source tables to split samples. The split counts keys while the plan is built."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edulake.operators.chat import last_question, parse_turns
from edulake.operators.normalize import SOURCES, SourceSpec, normalize_qa
from edulake.operators.split import holdout_split
from edulake.sources.samples import concat_same_schema, write_samples


def normalize_sources(
    sources: Mapping[str, DataFrame],
    specs: Mapping[str, SourceSpec] = SOURCES,
    caps: Mapping[str, int | None] | None = None,
) -> DataFrame:
    """Samples of all sources with a known shape, with ``dataset`` and a ``sample_key`` unique over all of them."""
    parts = []
    for name, table in sources.items():
        if name not in specs:
            continue
        part = normalize_qa(table, specs[name], max_samples=(caps or {}).get(name))
        parts.append(part.withColumn("dataset", F.lit(name)))
    merged = concat_same_schema(parts)
    return merged.withColumn("sample_key", F.concat_ws(":", "dataset", F.col("row_id").cast("string")))


def build_samples(
    sources: Mapping[str, DataFrame],
    settings: DataFrame | None = None,
    seed: str = "42",
    group_by_question: bool = False,
    question_chars: int | None = 100,
) -> DataFrame:
    """Normalised and split samples. Splitting ranks keys only; the image bytes never take part in a shuffle.

    Questions are the same when their first ``question_chars`` characters are, or as a whole with None.
    """
    samples = normalize_sources(sources)
    if not group_by_question:
        return holdout_split(samples, "sample_key", settings=settings, seed=seed)
    question = last_question(parse_turns(F.col("conversations")))
    if question_chars is not None:
        question = F.substring(question, 1, question_chars)
    keyed = samples.withColumn("question_key", F.md5(question))
    return holdout_split(keyed, "sample_key", settings=settings, seed=seed, group_key="question_key").drop(
        "question_key"
    )


def write_build(samples: DataFrame, path: str) -> None:
    write_samples(samples, path, partition_by=("dataset", "split"))
