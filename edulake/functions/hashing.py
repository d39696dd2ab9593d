"""Portable seeded randomness: the same key and seed give the same draw on every engine and every retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 52


def hash52(*parts: Column | str) -> Column:
    """First 52 bits of the MD5 of the parts joined by ``|``, as a non-negative bigint."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def unit(*parts: Column | str) -> Column:
    """A uniform double in [0, 1) derived from the parts."""
    return hash52(*parts) / F.lit(float(1 << HASH_BITS))
