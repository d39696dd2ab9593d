"""Benchmark items inside documents: size-partitioned MinHash containment search, verified by exact shingles.

Min-wise hashing orders the shingles of all texts alike. An item of n distinct shingles that a document contains to a
share of t lacks at most (1 - t) n of them there, so among its floor((1 - t) n) + 1 smallest hashes at least one is in
the document. Items are partitioned by size, since the length of that signature follows from the largest size of the
partition; documents, however long, need no signature and are probed with all their shingles. The search therefore
finds every pair, and the few it finds are verified on the shingles themselves. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edulake.session import settle

SHINGLE_WORDS = 5
CONTAINMENT = 0.8


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _shingles(rows: DataFrame, kept: list[str], words: int) -> DataFrame:
    """One row per shingle of the array ``words``: a hash ``h`` and its words ``w0``, ``w1``, ...

    A text of fewer words has one shingle, all its words; a text without words has none.
    """
    length = F.greatest(F.size("words") - F.lit(words - 1), F.lit(1))
    columns = [F.slice("words", i + 1, length).alias(f"w{i}") for i in range(words)]
    names = [f"w{i}" for i in range(words)]
    each = rows.select(*kept, F.inline(F.arrays_zip(*columns)).alias(*names)).where("w0 IS NOT NULL")
    return each.select(*kept, F.xxhash64(*names).alias("h"), *names)


def item_signatures(
    items: DataFrame, id: str, text: str, words: int = SHINGLE_WORDS, share: float = CONTAINMENT
) -> DataFrame:
    """The distinct shingles of every item: ``item``, ``shingle``, ``h``, ``n`` and whether it is ``probed``.

    Items are partitioned by size in powers of two; the ``floor((1 - share) * size) + 1`` smallest hashes of an item
    are probed, with the largest size of its partition.
    """
    rows = items.select(F.col(id).alias("item"), _words(F.col(text)).alias("words"))
    shingle = F.concat_ws(" ", *[f"w{i}" for i in range(words)])
    own = _shingles(rows, ["item"], words).select("item", "h", shingle.alias("shingle"))
    sets = own.groupBy("item").agg(F.array_sort(F.collect_set(F.struct("h", "shingle"))).alias("own"))
    sized = sets.withColumn("n", F.size("own").cast("bigint"))
    largest = F.pow(F.lit(2), F.ceil(F.log2("n") - F.lit(1e-9)))
    probes = F.floor(F.lit(1 - share + 1e-9) * largest) + 1
    each = sized.select("item", "n", probes.alias("probes"), F.posexplode("own").alias("rank", "one"))
    return each.select(
        "item", "one.shingle", "one.h", "n", (F.col("rank") < F.col("probes")).alias("probed")
    )


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    words: int = SHINGLE_WORDS,
    share: float = CONTAINMENT,
) -> DataFrame:
    """Per distinct text (as its digest ``d0``, ``d1``) and item it contains: ``item``, ``n_shared`` and ``n_item``.

    An item is contained when at least ``share`` of its distinct shingles of ``words`` lower-cased words stand in the
    text. Null and wordless texts contain nothing, and items without words are in nothing. Copies of a text are
    searched once; repeated items with one id are one item of all their shingles. Empty tables give no rows.
    """
    signatures = settle(item_signatures(items.where(F.col(item_id).isNotNull()), item_id, item_text, words, share))
    texts = docs.select(*digest(F.col(text)), F.col(text).alias("text")).where("text IS NOT NULL")
    named = ["d0", "d1"]
    probed = signatures.where("probed").select("h", "item")
    every = _shingles(texts.select(*named, _words(F.col("text")).alias("words")), named, words)
    candidates = settle(every.select(*named, "h").join(probed, "h").select(*named, "item").distinct())
    # Only the texts of candidates are looked at again, each once.
    chosen = texts.join(candidates.select(*named).distinct(), named, "left_semi").groupBy(*named)
    chosen = chosen.agg(F.first("text").alias("text"))
    shingle = F.concat_ws(" ", *[f"w{i}" for i in range(words)])
    held = _shingles(chosen.select(*named, _words(F.col("text")).alias("words")), named, words)
    held = held.select(*named, "h", shingle.alias("shingle"))
    shared = held.join(signatures, ["h", "shingle"]).groupBy(*named, "item", "n")
    shared = shared.agg(F.count_distinct("shingle").alias("n_shared")).where(F.col("n_shared") >= share * F.col("n"))
    exact = shared.join(candidates, [*named, "item"], "left_semi")
    return settle(exact.select(*named, "item", "n_shared", F.col("n").alias("n_item")))


def digest(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("d0"), F.xxhash64(F.lit(1), text).alias("d1")]


def contaminations(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row and contained item: the id, ``item_id``, ``n_shared``, ``n_item`` and ``containment``.

    Repeated rows each have their pairs. See ``contained_items`` for the rules.
    """
    found = contained_items(docs, items, text, **options)
    rows = docs.select(F.col(id).alias("id"), *digest(F.col(text)))
    return rows.join(found, ["d0", "d1"]).select(
        F.col("id").alias(id),
        F.col("item").alias("item_id"),
        "n_shared",
        "n_item",
        (F.col("n_shared") / F.col("n_item")).alias("containment"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows whose text contains no item, with all their columns. Rows with a null text stay."""
    bad = contained_items(docs, items, text, **options).select("d0", "d1").distinct()
    rows = docs.select(F.struct("*").alias("row"), *digest(F.col(text)))
    return rows.join(bad, ["d0", "d1"], "left_anti").select("row.*")


_SHINGLED = f"""
SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - {SHINGLE_WORDS - 2}, 2)),
                                          lambda i: list_slice(w, i, i + {SHINGLE_WORDS - 1}))) AS s
FROM {{words}} WHERE len(w) > 0
"""
_SPLIT = r"regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')"
SQL = f"""
WITH items AS (SELECT item_id AS id, {_SPLIT} AS w FROM benchmark),
docs AS (SELECT DISTINCT doc_id AS id, {_SPLIT} AS w FROM documents),
item_sets AS ({_SHINGLED.format(words="items")}),
sizes AS (SELECT id, count(*) AS n_item FROM item_sets GROUP BY id),
doc_sets AS ({_SHINGLED.format(words="docs")}),
shared AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
           FROM doc_sets d JOIN item_sets i ON d.s = i.s GROUP BY d.id, i.id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item::DOUBLE AS containment
FROM shared JOIN sizes ON sizes.id = item_id WHERE n_shared >= {CONTAINMENT} * n_item
"""
