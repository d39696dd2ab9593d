"""Sampling, weighting and ordering of rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edulake.functions.hashing import unit
from edulake.functions.permutation import Permutation
from edulake.operators.ranking import first_by_id, lowest, with_rank
from edulake.session import join_with_nulls, settle

#: Cells a unit interval is cut into, so that a draw meets its dataset through an equality join.
_CELLS = 1024


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows in input order."""
    return first_by_id(df, key, n)


def fraction_sample(df: DataFrame, key: str, rate: float, cap: int | None = None, seed: str = "42") -> DataFrame:
    """``floor(rows * rate)`` rows without replacement, then at most ``cap``."""

    def quota(total):
        wanted = F.floor(total * F.lit(rate))
        return wanted if cap is None else F.least(wanted, F.lit(cap))

    return lowest(df, [], key, seed, quota)


def random_n(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows without replacement, or all when there are fewer."""
    return lowest(df, [], key, seed, lambda total: F.lit(n))


def curated_sample(df: DataFrame, quotas: DataFrame, key: str, seed: str = "42") -> DataFrame:
    """Up to ``quota`` rows of every dataset named in ``quotas``; other datasets are left out."""
    return lowest(df, ["dataset"], key, seed, lambda total: F.coalesce("quota", F.lit(0)), quotas.select("dataset", "quota"))


def draw_shares(sizes: DataFrame, multipliers: DataFrame | None = None) -> DataFrame:
    """Per dataset the interval [lo, hi) of the unit line its draws fall in.

    A row weighs 1/sqrt(size of its dataset), so a dataset's share is proportional to sqrt(size). An optional
    table of multipliers (``dataset``, ``weight``) scales the shares.
    """
    shares = sizes.withColumn("mass", F.sqrt(F.col("size").cast("double")))
    if multipliers is not None:
        shares = (
            join_with_nulls(shares, multipliers.select("dataset", "weight"), ["dataset"], "left")
            .withColumn("mass", F.col("mass") * F.coalesce("weight", F.lit(1.0)))
            .drop("weight")
        )
    # One row per dataset.
    upto = F.sum("mass").over(Window.partitionBy().orderBy("dataset").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("mass").over(Window.partitionBy())
    return (
        shares.withColumn("upto", upto)
        .withColumn("total", total)
        .select(
            "dataset",
            "size",
            ((F.col("upto") - F.col("mass")) / F.col("total")).alias("lo"),
            F.when(F.row_number().over(Window.partitionBy().orderBy(F.desc("dataset"))) == 1, F.lit(1.0))
            .otherwise(F.col("upto") / F.col("total"))
            .alias("hi"),
        )
    )


def weighted_draws(
    df: DataFrame,
    key: str,
    draws: int | None = None,
    seed: str = "42",
    epoch: int = 0,
    multipliers: DataFrame | None = None,
) -> DataFrame:
    """Draw rows with replacement, each weighing 1/sqrt(size of its dataset); as many draws as rows by default.

    A draw picks a dataset by interval and then a row number inside it, so rows and draws meet on
    (dataset, row number). That key is spread evenly however large one dataset is.
    """
    spark = df.sparkSession
    sizes = settle(df.groupBy("dataset").agg(F.count("*").alias("size")))
    if draws is None:
        draws = sizes.agg(F.sum("size")).first()[0] or 0
    shares = draw_shares(sizes, multipliers)
    cells = settle(
        shares.where("hi > lo").select(
            "*",
            F.explode(
                F.sequence(
                    F.floor(F.col("lo") * _CELLS).cast("int"),
                    F.least(F.floor(F.col("hi") * _CELLS), F.lit(_CELLS - 1)).cast("int"),
                )
            ).alias("cell"),
        )
    )
    tag = f"{seed}|{epoch}"
    picks = (
        spark.range(draws)
        .withColumnRenamed("id", "draw")
        .withColumn("u", unit("d", tag, F.col("draw")))
        .withColumn("cell", F.floor(F.col("u") * _CELLS).cast("int"))
        .join(cells, "cell")
        .where("u >= lo and u < hi")
        .withColumn("position", F.floor(unit("r", tag, F.col("draw")) * F.col("size")) + 1)
        .select("draw", "dataset", "position")
    )
    rows = with_rank(df.select("dataset", key), ["dataset"], key, seed)
    return join_with_nulls(picks, rows, ["dataset", "position"]).select("draw", "dataset", key)


def number_rows(df: DataFrame, key: str) -> DataFrame:
    """The keys with a ``row_number`` from 0, settled. Done once for a dataset; all epochs permute these numbers."""
    return settle(with_rank(df.select(key), [], key, "rows", "__rank").select(key, (F.col("__rank") - 1).alias("row_number")))


def _permutation(numbered: DataFrame, seed: int, epoch: int) -> Permutation:
    return Permutation(numbered.count(), str(seed + epoch))


def epoch_order(df: DataFrame, key: str, seed: int = 42, epoch: int = 0) -> DataFrame:
    """A permutation of the keys for one epoch, as a 1-based ``position``.

    A row's position is computed from its number alone, without a sort or shuffle. ``df`` is the result of
    ``number_rows``, or any table with the key, which is numbered first.
    """
    numbered = df if "row_number" in df.columns else number_rows(df, key)
    place = _permutation(numbered, seed, epoch).place_column(F.col("row_number"))
    return numbered.select(key, (place + 1).alias("position"))


def assign_batches(ordered: DataFrame, batch_size: int, skip_batches: int = 0) -> DataFrame:
    """Cut an ordered table into batches, leave out the first ones, keep the short last one."""
    batch = F.floor((F.col("position") - 1) / batch_size).cast("bigint")
    return ordered.withColumn("batch_id", batch).where(F.col("batch_id") >= skip_batches)


def batch_rows(
    numbered: DataFrame, key: str, batches: Iterable[int], batch_size: int, seed: int = 42, epoch: int = 0
) -> DataFrame:
    """The rows of some batches of an epoch: ``key``, ``position`` and ``batch_id``.

    The numbers of the rows are computed from the positions asked for, and only these rows are looked up in the result
    of ``number_rows``, by a filter that the scan can use. What is asked for passes through the driver.
    """
    permutation = _permutation(numbered, seed, epoch)
    wanted = [
        (permutation.number(place), place + 1, batch)
        for batch in batches
        for place in range(batch * batch_size, min((batch + 1) * batch_size, permutation.n))
    ]
    places = numbered.sparkSession.createDataFrame(wanted, "row_number bigint, position bigint, batch_id bigint")
    found = numbered.where(F.col("row_number").isin([w[0] for w in wanted]))
    return found.join(F.broadcast(places), "row_number").select(key, "position", "batch_id")


def resume_position(total_rows: int, batch_size: int, done_steps: int) -> tuple[int, int]:
    """Epoch and batches to skip in it after so many finished steps."""
    per_epoch = total_rows // batch_size
    if per_epoch == 0:
        return 0, done_steps
    return done_steps // per_epoch, done_steps % per_epoch


def shard(ordered: DataFrame, world: int) -> DataFrame:
    """Deal an ordered table out to so many workers."""
    return ordered.withColumn("worker", F.pmod(F.col("position") - 1, F.lit(world)).cast("int"))


def audit_sample(df: DataFrame, key: str, n: int = 50, seed: str = "42") -> DataFrame:
    """Rows for manual review: the same number from every dataset, at least one, named ``<dataset>_000`` on."""
    datasets = df.select("dataset").distinct().count()
    per_dataset = max(1, n // max(datasets, 1))
    chosen = lowest(df, ["dataset"], key, seed, lambda total: F.lit(per_dataset))
    # At most ``per_dataset`` rows of a dataset are left.
    order = Window.partitionBy("dataset").orderBy(key)
    number = F.row_number().over(order) - 1
    return chosen.select(
        "dataset",
        key,
        F.format_string("%s_%03d", F.col("dataset"), number).alias("audit_id"),
        F.lit(True).alias("to_audit"),
    ).orderBy("audit_id")
