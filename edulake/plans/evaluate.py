"""From responses to a scored run with intervals, checks and report tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edulake.functions.lexicon import ACCURACY_RULES, GUIDANCE_WORDS, GUIDANCE_WORDS_SCIENCE
from edulake.functions.text import contains_any
from edulake.operators import bootstrap, checks, errors, report, summary
from edulake.operators.scoring import answer_contained, answer_in_prefix, step_flag, token_overlap
from edulake.schema import METRICS
from edulake.session import settle


@dataclass
class Evaluation:
    """Tables of one evaluated run."""

    scored: DataFrame
    summary: DataFrame
    intervals: DataFrame
    findings: DataFrame
    errors: DataFrame
    weakest: DataFrame


def score_responses(responses: DataFrame, rules: Mapping[str, str] = ACCURACY_RULES) -> DataFrame:
    """The three flags and the length of every response (``dataset``, ``response``, ``gt_answer``).

    ``rules`` names the accuracy rule of a dataset: ``contained`` looks for the answer in the whole response and knows
    one more guidance word, ``prefix`` looks in its beginning; all other datasets go by shared words.
    """

    def ruled(rule: str) -> Column:
        names = [dataset for dataset, own in rules.items() if own == rule]
        return F.coalesce(F.col("dataset").isin(*names), F.lit(False)) if names else F.lit(False)

    response, answer = F.col("response"), F.col("gt_answer")
    right = (
        F.when(ruled("contained"), answer_contained(response, answer))
        .when(ruled("prefix"), answer_in_prefix(response, answer))
        .otherwise(token_overlap(response, answer))
    )
    guided = F.when(ruled("contained"), contains_any(response, GUIDANCE_WORDS_SCIENCE)).otherwise(
        contains_any(response, GUIDANCE_WORDS)
    )
    return responses.select(
        "*",
        right.cast("int").alias("accuracy"),
        step_flag(response).cast("int").alias("step_completeness"),
        guided.cast("int").alias("scaffolding_rate"),
        F.length(response).alias("response_length"),
    )


def evaluate(responses: DataFrame, rules: Mapping[str, str] = ACCURACY_RULES) -> Evaluation:
    """Score once, settle the marks without the texts, and derive every table of the run from them."""
    wrong = F.when(F.col("accuracy") != 1, errors.error_type(F.col("response")))
    scored = settle(
        score_responses(responses, rules).select(
            "dataset", "sample_id", *METRICS, "response_length", wrong.alias("error_type")
        )
    )
    run = settle(summary.dataset_summary(scored, length="response_length"))
    return Evaluation(
        scored=scored,
        summary=run,
        intervals=bootstrap.attached_intervals(
            bootstrap.confidence_intervals(bootstrap.long_scores(scored, ["dataset"]))
        ),
        findings=checks.consistency_checks(run.withColumn("run_id", F.lit("current"))),
        errors=errors.error_distribution(scored.where("error_type is not null")),
        weakest=report.weakest_datasets(run),
    )
