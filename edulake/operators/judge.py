"""Scores given by a judge model: prompt text, parsing of its output, aggregation, and the hybrid reward."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edulake.functions import text as tx
from edulake.functions.lexicon import (
    ANSWER_FORMATS,
    DEFAULT_LEXICON,
    JUDGE_EMPTY,
    JUDGE_TEMPLATE,
    JUDGE_WEIGHTS,
    RULE_WEIGHTS,
    Lexicon,
)
from edulake.functions.numeric import clamp, weighted_sum
from edulake.operators.scoring import rule_reward
from edulake.schema import DIMENSIONS


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    if abs(sum(weights.values()) - 1.0) >= 1e-6:
        raise ValueError(f"weights must sum to 1, got {sum(weights.values())}")
    return weights


def judge_prompt(question: Column, response: Column, answer: Column) -> Column:
    """The judge's instruction text with the three fields filled in."""
    values = {"question": question, "gt": answer, "response": response}
    parts: list[Column] = []
    rest = JUDGE_TEMPLATE
    for name in ("question", "gt", "response"):
        before, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(before), tx.first_truthy(values[name], F.lit(JUDGE_EMPTY[name]))]
    return F.concat(*parts, F.lit(rest))


def judge_scores(output: Column) -> Column:
    """Five scores between 0 and 10 from a judge's free text, or null when they cannot be read."""
    raw = F.from_json(
        F.regexp_extract(output, r"\{[^}]+\}", 0), "map<string,string>", {"allowSingleQuotes": "false"}
    )
    values = tx.let(
        raw,
        lambda scores: F.struct(
            *[F.try_element_at(scores, F.lit(name)).try_cast("double").alias(name) for name in DIMENSIONS]
        ),
    )

    def clamped(scores: Column) -> Column:
        complete = F.lit(True)
        for name in DIMENSIONS:
            complete = complete & scores[name].isNotNull()
        return F.when(complete, F.struct(*[clamp(scores[name], 0, 10).alias(name) for name in DIMENSIONS]))

    return tx.let(values, clamped)


def judge_reward(scores: Column, weights: dict[str, float] = JUDGE_WEIGHTS) -> Column:
    """Weighted mean of a score struct on the scale 0 to 1; an unreadable output counts 0."""
    check_weights(weights)
    return _judge_total(scores, weights)


def _judge_total(scores: Column, weights: dict[str, float]) -> Column:
    total = weighted_sum({name: scores[name] for name in weights}, weights)
    return F.coalesce(total / 10.0, F.lit(0.0))


def answer_format_score(response: Column) -> Column:
    """How clearly the response states its final answer."""
    score = F.when(F.coalesce(response, F.lit("")) == "", F.lit(0.0))
    for pattern, value in ANSWER_FORMATS:
        score = score.when(tx.matches(response, pattern), F.lit(value))
    return score.otherwise(F.lit(0.3))


def hybrid_reward(
    judge: Column,
    rule: Column,
    response: Column,
    judge_weight: float = 0.7,
    rule_weight: float = 0.2,
    format_weight: float = 0.1,
    double_scale: bool = False,
) -> Column:
    """Judge, rule and answer-format score in one number.

    ``double_scale`` applies the judge's weight twice, so its effective share is the weight squared.
    """
    check_weights({"judge": judge_weight, "rule": rule_weight, "format": format_weight})
    scale = judge_weight * judge_weight if double_scale else judge_weight
    return judge * scale + rule * rule_weight + answer_format_score(response) * format_weight


# -- scorers by name ---------------------------------------------------------------------------------------

Scorer = Callable[[Column, Column, Column], Column]


def rule_scorer(lexicon: Lexicon = DEFAULT_LEXICON, weights: dict[str, float] = RULE_WEIGHTS) -> Scorer:
    return lambda response, answer, _judged: rule_reward(response, answer, lexicon, weights)


def judged_scorer(weights: dict[str, float] = JUDGE_WEIGHTS) -> Scorer:
    return lambda _response, _answer, judged: judge_reward(judge_scores(judged), weights)


def hybrid_scorer(double_scale: bool = False, lexicon: Lexicon = DEFAULT_LEXICON) -> Scorer:
    return lambda response, answer, judged: hybrid_reward(
        judge_reward(judge_scores(judged)),
        rule_reward(response, answer, lexicon),
        response,
        double_scale=double_scale,
    )


SCORERS: dict[str, Callable[..., Scorer]] = {
    "rule": rule_scorer,
    "judged": judged_scorer,
    "hybrid": hybrid_scorer,
}


def create_scorer(backend: str, **options) -> Scorer:
    if backend not in SCORERS:
        raise ValueError(f"unknown scorer {backend!r}; known: {sorted(SCORERS)}")
    return SCORERS[backend](**options)


def score(
    df: DataFrame,
    scorer: Scorer,
    response: str = "response",
    answer: str = "gt_answer",
    judged: str = "judge_output",
    to: str = "reward",
) -> DataFrame:
    """Add a reward column. Works row by row, so a group of candidates needs no grouping to be scored."""
    judged_col = F.col(judged) if judged in df.columns else F.lit(None).cast("string")
    return df.withColumn(to, scorer(F.col(response), F.col(answer), judged_col))


#: A judge as a worker calls it: prompts in, one text for each out.
Model = Callable[[Sequence[str]], Sequence[str]]

PROMPTS_AT_ONCE = 32


def judge_outputs(make_model: Callable[[], Model], batch_size: int = PROMPTS_AT_ONCE) -> Callable[[Column], Column]:
    """A column function from judge prompts to the texts of a model.

    ``make_model`` runs once in a worker, which keeps the model for all its tasks. A model gets ``batch_size`` prompts at
    once at most, however many rows an Arrow batch has; null prompts are empty.
    """

    def make_predict():
        model = make_model()

        def predict(prompts: np.ndarray) -> np.ndarray:
            return np.array([str(x) for x in model([p or "" for p in prompts.tolist()])], dtype=object)

        return predict

    return predict_batch_udf(make_predict, return_type=T.StringType(), batch_size=batch_size)


def score_with_model(
    df: DataFrame,
    make_model: Callable[[], Model],
    backend: str = "judged",
    question: str = "question",
    response: str = "response",
    answer: str = "gt_answer",
    to: str = "reward",
    batch_size: int = PROMPTS_AT_ONCE,
    **options,
) -> DataFrame:
    """Add the reward of a user's judge model: prompt, answer of the model, scores and their total, or the hybrid of it.

    A text that holds no scores counts 0. ``judge_output`` carries what the model said.
    """
    prompt = judge_prompt(F.col(question), F.col(response), F.col(answer))
    judged = df.withColumn("judge_output", judge_outputs(make_model, batch_size)(prompt))
    return score(judged, create_scorer(backend, **options), response, answer, to=to)


def score_groups(
    groups: DataFrame,
    key: str,
    make_model: Callable[[], Model],
    backend: str = "judged",
    question: str = "question",
    responses: str = "responses",
    answer: str = "gt_answer",
    batch_size: int = PROMPTS_AT_ONCE,
    **options,
) -> DataFrame:
    """``key`` and ``rewards``, one for each of the row's ``responses`` and in their order; ``key`` is unique.

    Candidates of all groups fill the model's batches together. Only key, place and reward are shuffled, and a group is no
    larger than the row it came in. No responses give an empty list.
    """
    each = groups.select(key, question, answer, F.posexplode(responses).alias("place", "response"))
    scored = score_with_model(each, make_model, backend, question, "response", answer, "reward", batch_size, **options)
    pairs = F.sort_array(F.collect_list(F.struct("place", "reward")))
    rewards = scored.groupBy(key).agg(F.transform(pairs, lambda p: p["reward"]).alias("rewards"))
    none = F.array().cast("array<double>")
    return groups.select(key).join(rewards, key, "left").select(key, F.coalesce("rewards", none).alias("rewards"))
