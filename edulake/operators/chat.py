"""Projections and filters over chat samples.

Most functions work on the parsed turns of one sample (``array<struct<role, content>>``). Those that take a
turn table (one row per turn) use aggregates, so a conversation never has to be collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edulake.functions.hashing import hash52, unit
from edulake.functions.lexicon import ASSISTANT_MARKERS, EMPTY_USER_TEXT, EVAL_PROMPTS, TUTOR_PROMPTS
from edulake.functions.text import first_truthy, strip
from edulake.schema import TURN, TURNS
from edulake.session import settle

IMAGE_TAG = "<image>"


def parse_turns(conversations: Column) -> Column:
    return F.from_json(conversations, TURNS)


def encode_turns(turns: Column) -> Column:
    return F.to_json(turns)


def has_image_tag(turns: Column) -> Column:
    return F.exists(turns, lambda t: F.coalesce(t["content"], F.lit("")).contains(IMAGE_TAG))


def first_image(image_bytes: Column) -> Column:
    return F.try_element_at(image_bytes, F.lit(1))


def question_text(content: Column) -> Column:
    """Content without image tags and outer white space."""
    return strip(F.replace(content, F.lit(IMAGE_TAG), F.lit("")))


def seeded_prompt(key: Column, seed: str, prompts: tuple[str, ...] = TUTOR_PROMPTS) -> Column:
    """One of the prompts, picked by the row's key."""
    number = F.pmod(hash52("prompt", seed, key), F.lit(len(prompts))).cast("int")
    return F.element_at(F.array(*[F.lit(p) for p in prompts]), number + 1)


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content")).cast(TURN)


def inject_system_prompt(turns: Column, key: Column, probability: float = 1.0, seed: str = "42") -> Column:
    """Put a prompt in front, with the given probability, unless the first turn is a system turn already."""
    chosen = unit("inject", seed, key) < probability
    open_start = F.coalesce(F.get(turns, F.lit(0))["role"], F.lit("")) != "system"
    return F.when(
        chosen & open_start, F.concat(F.array(_turn("system", seeded_prompt(key, seed))), turns)
    ).otherwise(turns)


def render_messages(turns: Column) -> Column:
    """Messages with typed parts: a tagged user turn becomes an image and a text, any other turn a text."""

    def render(turn: Column) -> Column:
        tagged = (turn["role"] == "user") & turn["content"].contains(IMAGE_TAG)
        text = F.when(tagged, first_truthy(question_text(turn["content"]), F.lit(EMPTY_USER_TEXT))).otherwise(
            turn["content"]
        )
        parts = F.when(tagged, F.array(F.lit("image"), F.lit("text"))).otherwise(F.array(F.lit("text")))
        return F.struct(turn["role"].alias("role"), parts.alias("parts"), text.alias("text"))

    return F.transform(turns, render)


def prompt_turns(turns: Column, key: Column, seed: str = "42") -> Column:
    """System and user turns before the first assistant turn, with a fresh system text and clean user text."""
    roles = F.transform(turns, lambda t: t["role"])
    first = F.array_position(roles, F.lit("assistant"))
    length = F.when(first == 0, F.size(turns)).otherwise(first.cast("int") - 1)
    kept = F.filter(F.slice(turns, F.lit(1), length), lambda t: t["role"].isin("system", "user"))
    text = lambda t: F.when(t["role"] == "system", seeded_prompt(key, seed)).otherwise(
        first_truthy(question_text(t["content"]), F.lit(EMPTY_USER_TEXT))
    )
    return F.transform(kept, lambda t: F.struct(t["role"].alias("role"), text(t).alias("content")))


def first_answer(turns: Column) -> Column:
    """Content of the first assistant turn, or empty text."""
    answers = F.filter(turns, lambda t: t["role"] == "assistant")
    return F.coalesce(F.get(answers, F.lit(0))["content"], F.lit(""))


def last_question(turns: Column) -> Column:
    """Clean content of the last user turn, or empty text."""
    asked = F.filter(turns, lambda t: t["role"] == "user")
    return F.coalesce(question_text(F.try_element_at(asked, F.lit(-1))["content"]), F.lit(""))


def last_answer(turns: Column) -> Column:
    """Content of the last assistant turn, or empty text."""
    answers = F.filter(turns, lambda t: t["role"] == "assistant")
    return F.coalesce(F.try_element_at(answers, F.lit(-1))["content"], F.lit(""))


def with_question(df: DataFrame, question: str = "question") -> DataFrame:
    """Leave rows with an empty question out."""
    return df.where(F.length(question) > 0)


def answer_offset(rendered: Column) -> Column:
    """Characters before the supervised part of a rendered conversation; null when no marker is found."""
    offsets = []
    for marker in ASSISTANT_MARKERS:
        at = F.instr(rendered, F.lit(marker))
        offsets.append(F.when(at > 0, at - 1 + len(marker)))
    return F.coalesce(*offsets)


def eval_prompt(question: Column, kind: str = "plain") -> Column:
    return F.concat(F.lit(EVAL_PROMPTS[kind] + "\n"), question)


# -- turn tables -------------------------------------------------------------------------------------------


def question_answer(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """Last user text and last assistant text of every conversation."""
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    return turns.groupBy(by).agg(
        F.coalesce(question_text(last("user")), F.lit("")).alias("question"),
        F.coalesce(last("assistant"), F.lit("")).alias("gt_answer"),
    )


def first_answer_by_turn(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """First assistant text of every conversation, or empty text."""
    mine = F.col("role") == "assistant"
    return turns.groupBy(by).agg(
        F.coalesce(F.min_by(F.when(mine, F.col("text")), F.when(mine, F.col("turn"))), F.lit("")).alias("gt_response")
    )


def prompt_part(turns: DataFrame, by: str = "conv_id", seed: str = "42") -> DataFrame:
    """Turns before the first assistant turn, with a fresh system text and clean user text."""
    first = settle(turns.groupBy(by).agg(F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("__first")))
    kept = turns.join(first, by).where(
        (F.col("__first").isNull() | (F.col("turn") < F.col("__first"))) & F.col("role").isin("system", "user")
    )
    text = F.when(F.col("role") == "system", seeded_prompt(F.col(by), seed)).otherwise(
        first_truthy(question_text(F.col("text")), F.lit(EMPTY_USER_TEXT))
    )
    return kept.select(by, "turn", "role", text.alias("content"))
