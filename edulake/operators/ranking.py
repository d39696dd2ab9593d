"""Exact ranks and exact lowest-n selection without sorting a whole group in one task.

Rows are ordered by ``(hash, key)`` within a group. The hash is uniform, so its top bits cut every group, hot
ones too, into even buckets. Bucket counts are pre-aggregated before the shuffle, and running totals over them
say in which bucket the n-th row lies; only that bucket's rows are sorted. The full rank of a row is the
running total before its bucket plus its rank inside the bucket. Null groups are groups like any other, and keys
may repeat: of the copies of the key at the cut as many are taken as are needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edulake.functions.hashing import HASH_BITS, hash52
from edulake.session import join_with_nulls, settle

#: Buckets per group. At 10^11 rows in one group a bucket still holds only some 24 million keys.
BUCKET_BITS = 12

_HASH, _BUCKET = "__hash", "__bucket"


def _keyed(df: DataFrame, key: str, seed: str) -> DataFrame:
    hashed = df.withColumn(_HASH, hash52(seed, F.col(key)))
    return hashed.withColumn(_BUCKET, F.shiftright(_HASH, HASH_BITS - BUCKET_BITS).cast("int"))


def _bucket_totals(keyed: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per group and bucket: rows, running rows, and the group's total."""
    counts = keyed.groupBy(*groups, _BUCKET).agg(F.count("*").alias("cnt"))
    running = Window.partitionBy(*groups).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    return counts.select(
        *groups,
        _BUCKET,
        "cnt",
        F.sum("cnt").over(running).alias("upto"),
        F.sum("cnt").over(whole).alias("total"),
    )


def lowest_cut(
    df: DataFrame,
    groups: Sequence[str],
    key: str,
    seed: str,
    quota: Callable[[Column], Column],
    quotas: DataFrame | None = None,
) -> DataFrame:
    """Per group: ``total``, ``n = quota(total)`` and the (hash, key) of the n-th lowest row.

    ``quotas`` adds columns per group that ``quota`` may refer to; they are null for groups missing from it.
    ``take`` of the ``copies`` of the cut's key belong to the n lowest. One row per group, settled.
    """
    # The keys are read twice; settled, an expensive source is computed once.
    slim = settle(_keyed(df.select(*groups, key), key, seed))
    totals = _bucket_totals(slim, groups)
    if quotas is not None:
        totals = join_with_nulls(totals, quotas, groups, "left")
    wanted = F.least(F.greatest(quota(F.col("total")), F.lit(0)), F.col("total")).cast("bigint")
    totals = settle(totals.select(*groups, _BUCKET, "cnt", "upto", "total", wanted.alias("n")))
    edge = totals.where((F.col("upto") >= F.col("n")) & (F.col("upto") - F.col("cnt") < F.col("n")))
    edge = edge.select(*groups, _BUCKET, "total", "n", (F.col("n") - F.col("upto") + F.col("cnt")).alias("need"))
    # Of every group only the keys of one bucket come through here, each once.
    near = join_with_nulls(slim, edge, [*groups, _BUCKET])
    candidates = near.groupBy(*groups, _BUCKET, "total", "n", "need", _HASH, key).agg(F.count("*").alias("copies"))
    order = Window.partitionBy(*groups, _BUCKET).orderBy(_HASH, key).rowsBetween(Window.unboundedPreceding, 0)
    take = F.col("need") - F.col("__upto") + F.col("copies")
    last = (
        candidates.withColumn("__upto", F.sum("copies").over(order))
        .where((F.col("__upto") >= F.col("need")) & (F.col("__upto") - F.col("copies") < F.col("need")))
        .select(
            *groups,
            "total",
            "n",
            F.col(_HASH).alias("cut_hash"),
            F.col(key).alias("cut_key"),
            take.alias("take"),
            "copies",
        )
    )
    empty = (
        totals.where("n = 0")
        .select(*groups, "total", "n")
        .distinct()
        .withColumn("cut_hash", F.lit(-1).cast("bigint"))
        .withColumn("cut_key", F.lit(None).cast(df.schema[key].dataType))
        .withColumn("take", F.lit(0).cast("bigint"))
        .withColumn("copies", F.lit(0).cast("bigint"))
    )
    return settle(last.unionByName(empty))


def with_lowest_mark(
    df: DataFrame, groups: Sequence[str], key: str, seed: str, cut: DataFrame, to: str = "selected"
) -> DataFrame:
    """Mark the rows below their group's cut, and as many copies of the cut's own key as belong there.

    A map-side pass: no row is shuffled but copies of a key that the cut divides. Every row of ``df`` comes back.
    """
    divided = not cut.where("take < copies").isEmpty()
    cuts = cut.select(*groups, "cut_hash", "cut_key", "take", "copies")
    hashed = df.withColumn(_HASH, hash52(seed, F.col(key)))
    joined = join_with_nulls(hashed, cuts, groups, "left")
    at = (F.col(_HASH) == F.col("cut_hash")) & F.col(key).eqNullSafe(F.col("cut_key"))
    below = (F.col(_HASH) < F.col("cut_hash")) | (
        (F.col(_HASH) == F.col("cut_hash")) & (F.col(key) < F.col("cut_key"))
    )
    marked = joined.withColumn("__at", F.coalesce(at, F.lit(False))).withColumn(to, F.coalesce(below, F.lit(False)))
    if not divided:
        marked = marked.withColumn(to, F.col(to) | F.col("__at"))
    else:
        split = F.col("__at") & (F.col("take") < F.col("copies"))
        whole = marked.where(~split).withColumn(to, F.col(to) | F.col("__at"))
        order = Window.partitionBy(*groups, key).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
        copies = marked.where(split).withColumn(to, F.row_number().over(order) <= F.col("take"))
        marked = whole.unionByName(copies)
    return marked.drop(_HASH, "cut_hash", "cut_key", "take", "copies", "__at")


def lowest(
    df: DataFrame,
    groups: Sequence[str],
    key: str,
    seed: str,
    quota: Callable[[Column], Column],
    quotas: DataFrame | None = None,
) -> DataFrame:
    """The ``quota(total)`` lowest rows of every group by (hash, key)."""
    cut = lowest_cut(df, groups, key, seed, quota, quotas)
    return with_lowest_mark(df, groups, key, seed, cut, "__keep").where("__keep").drop("__keep")


def with_rank(df: DataFrame, groups: Sequence[str], key: str, seed: str, to: str = "position") -> DataFrame:
    """1-based rank by (hash, key) within the group, over any number of rows.

    Pass only the columns that are needed; wide payloads are joined back by key afterwards.
    """
    keyed = settle(_keyed(df, key, seed))
    totals = settle(_bucket_totals(keyed, groups))
    before = totals.select(*groups, _BUCKET, (F.col("upto") - F.col("cnt")).alias("__before"))
    order = Window.partitionBy(*groups, _BUCKET).orderBy(_HASH, key)
    ranked = join_with_nulls(keyed, before, [*groups, _BUCKET]).withColumn(
        to, F.col("__before") + F.row_number().over(order)
    )
    return ranked.drop(_HASH, _BUCKET, "__before")


def first_by_id(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the lowest ids of any type that sorts; null ids come first, and ids may repeat.

    The distinct ids are dealt out by range and counted, which tells the range of the n-th; only that range is ranked.
    The result is a plain filter on the id that the scan can use to skip files.
    """
    if n <= 0:
        return df.where(F.lit(False))
    counts = df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("copies"))
    dealt = settle(counts.repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    # One row per partition.
    sums = dealt.groupBy("part").agg(F.sum("copies").alias("all"))
    sums = sums.withColumn("upto", F.sum("all").over(Window.partitionBy().orderBy("part")))
    edge = sums.where((F.col("upto") >= n) & (F.col("upto") - F.col("all") < n))
    near = dealt.join(F.broadcast(edge), "part")
    place = F.col("upto") - F.col("all") + F.sum("copies").over(Window.partitionBy("part").orderBy("id"))
    row = near.withColumn("place", place).where((F.col("place") >= n) & (F.col("place") - F.col("copies") < n)).first()
    if row is None:
        return df
    last = F.lit(row["id"]).cast(df.schema[key].dataType)
    take = n - row["place"] + row["copies"]
    lower = F.col(key).isNull() | (F.col(key) < last) if row["id"] is not None else F.lit(False)
    own = F.col(key).eqNullSafe(last)
    if take == row["copies"]:
        return df.where(F.coalesce(lower, F.lit(False)) | own)
    ties = df.where(own).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).limit(take)
    return df.where(F.coalesce(lower, F.lit(False))).unionByName(ties)


#: Parts that a group is cut into before its first rows are taken.
PARTS = 256


def first_per_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, to: str = "__rn"
) -> DataFrame:
    """The first n rows of every group, numbered from 1.

    A group's rows are dealt into parts, each part is cut to n rows, and then the parts of a group meet: one task gets
    ``PARTS * n`` rows of a group at most, whatever its size and the number of input partitions.
    """
    part = F.pmod(F.xxhash64(F.struct("*")), F.lit(PARTS))
    within = Window.partitionBy(*groups, "__part").orderBy(*order)
    cut = df.withColumn("__part", part).withColumn(to, F.row_number().over(within)).where(F.col(to) <= n)
    whole = Window.partitionBy(*groups).orderBy(*order)
    return cut.drop("__part").withColumn(to, F.row_number().over(whole)).where(F.col(to) <= n)
