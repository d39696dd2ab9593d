"""Numeric helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def round_exact(value: Column, digits: int) -> Column:
    """Round the exact binary value to so many decimals, exact ties to the even digit.

    The JVM rounds the shortest decimal text of a double and takes ties up, which turns 6.25 into 6.3 and not 6.2.
    Only a scaled value that comes out as an odd number of half units can be a tie; the rounding error of the
    scaling, computed without loss from a split of the value, says on which side it really lies.
    """
    units = F.lit(2.0 * 10**digits)
    size = F.abs(value)
    scaled = size * units
    spread = size * F.lit(134217729.0)
    high = spread - (spread - size)
    error = (high * units - scaled) + (size - high) * units
    low = F.floor(scaled / 2)
    half = (scaled == F.floor(scaled)) & (F.pmod(F.floor(scaled), F.lit(2)) == 1)
    up = F.when(error > 0, 1).when(error < 0, 0).otherwise(F.pmod(low, F.lit(2)))
    rounded = F.when(half, low + up).otherwise(F.floor(scaled / 2 + 0.5)) / F.lit(float(10**digits))
    return F.when(value < 0, -rounded).otherwise(rounded)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (Abramowitz and Stegun 7.1.26, error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = F.lit(0.0)
    for coefficient in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = (poly + F.lit(coefficient)) * t
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.when(z < 0, (F.lit(1.0) - erf) / 2).otherwise((F.lit(1.0) + erf) / 2)


def weighted_sum(values: dict[str, Column], weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + values[name] * F.lit(weight)
    return total
