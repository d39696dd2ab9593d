"""Bloom filters as a value of a query: built from a small table, asked row by row in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes of a key, and bits of the filter for each key; the largest filter takes a megabyte.
HASHES = 5
BITS_PER_KEY = 10
MOST_BITS = 1 << 23


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(turn)), F.lit(bits)) for turn in range(HASHES)]


class BloomFilter:
    """The filter of a column's values, null among them. Of more keys than it has bits for it lets more others through.

    The words of the filter are a subquery of the plan that asks it, so they reach the scan as one value and not as a join.
    """

    def __init__(self, keys: DataFrame, key: str):
        wanted = max(keys.count() * BITS_PER_KEY, 1024)
        self.bits = min(1 << (wanted - 1).bit_length(), MOST_BITS)
        places = keys.select(F.explode(F.array(*_places(F.col(key), self.bits))).alias("place"))
        word, bit = F.call_function("shiftright", F.col("place"), F.lit(6)), F.col("place").bitwiseAND(F.lit(63))
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int"))
        words = places.groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits"))
        whole = keys.sparkSession.range(self.bits >> 6).withColumnRenamed("id", "word").join(words, "word", "left")
        entry = F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
        # As many entries as the filter has words.
        self.words = whole.agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["bits"]).alias("words"))

    def might_contain(self, key: Column) -> Column:
        """False only for values that are not among the keys."""
        found = F.lit(True)
        for place in _places(key, self.bits):
            word = F.get(self.words.scalar(), F.call_function("shiftright", place, F.lit(6)).cast("int"))
            bit = F.call_function("shiftright", word, place.bitwiseAND(F.lit(63)).cast("int"))
            found = found & (bit.bitwiseAND(F.lit(1).cast("bigint")) == 1)
        return found
