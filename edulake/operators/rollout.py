"""Groups of candidate responses per prompt: advantages, clipped surrogate, sequence log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edulake.functions.text import let, strip
from edulake.session import settle

EPS = 1e-8
#: Parts that a prompt's candidates are added up in.
PARTS = 256


def drop_blank(df: DataFrame, response: str = "response") -> DataFrame:
    """Blank candidates leave their group."""
    return df.where(strip(F.col(response)) != "")


def group_advantage(df: DataFrame, prompt: str = "prompt_id", reward: str = "reward") -> DataFrame:
    """Reward standardised within its prompt; equal rewards and single candidates get 0.

    The group's mean and deviation are aggregated first and joined back. A window would hold a whole group in
    one task; here partial sums are shuffled, and adaptive execution splits a prompt that fills a partition.
    """
    stats = settle(df.groupBy(prompt).agg(F.avg(reward).alias("__mean"), F.stddev_samp(reward).alias("__sd")))
    flat = F.col("__sd").isNull() | (F.col("__sd") < EPS)
    advantage = F.when(flat, F.lit(0.0)).otherwise((F.col(reward) - F.col("__mean")) / (F.col("__sd") + EPS))
    return df.join(stats, prompt).withColumn("advantage", advantage).drop("__mean", "__sd")


def clipped_term(old: Column, new: Column, advantage: Column, clip: float = 0.2) -> Column:
    ratio = F.exp(new - old)
    clipped = F.greatest(F.lit(1 - clip), F.least(F.lit(1 + clip), ratio))
    return -F.least(ratio * advantage, clipped * advantage)


def surrogate_loss(
    df: DataFrame, prompt: str = "prompt_id", batch: str | None = None, clip: float = 0.2
) -> DataFrame:
    """Clipped surrogate per prompt, and averaged over the prompts of a batch when one is given.

    A prompt's terms are added up in parts first, so that one prompt with most of the candidates is not one task.
    """
    term = clipped_term(F.col("logp_old"), F.col("logp_new"), F.col("advantage"), clip)
    keys = [prompt] if batch is None else [batch, prompt]
    part = F.pmod(F.xxhash64("logp_old", "logp_new", "advantage"), F.lit(PARTS)).alias("__part")
    parts = df.groupBy(*keys, part).agg(F.sum(term).alias("__sum"), F.count(term).alias("__n"))
    per_prompt = parts.groupBy(*keys).agg(F.try_divide(F.sum("__sum"), F.sum("__n")).alias("loss"))
    if batch is None:
        return per_prompt
    return per_prompt.groupBy(batch).agg(F.avg("loss").alias("loss"), F.count("*").alias("prompts"))


def sequence_logp(logp: Column, label: Column, ignore: int = -100) -> Column:
    """Sum of the token log-probabilities under supervision, their number, and their mean."""
    kept = F.filter(
        F.arrays_zip(logp.alias("logp"), label.alias("label")), lambda t: t["label"] != F.lit(ignore)
    )

    def summed(tokens: Column) -> Column:
        total = F.aggregate(tokens, F.lit(0.0), lambda s, t: s + t["logp"].cast("double"))
        count = F.size(tokens)
        return F.struct(
            total.alias("logp_sum"), count.alias("tokens"), (total / F.greatest(count, F.lit(1))).alias("logp_mean")
        )

    return let(kept, summed)


def reward_trend(df: DataFrame, step: str = "step", reward: str = "reward", interval: int = 10) -> DataFrame:
    """Mean reward per logging interval."""
    return df.groupBy(F.floor(F.col(step) / interval).cast("bigint").alias("interval")).agg(
        F.count("*").alias("rollouts"), F.avg(reward).alias("avg_reward")
    )
