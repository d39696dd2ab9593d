"""Quantiles of Poisson distributions from portable random numbers, the same in numpy and in SQL."""

from __future__ import annotations

import functools
import math

import numpy as np

#: Multipliers that mix a seed and a replicate into 31 bits.
MIX = (0x1E3779B1, 0x2C1B3C6D, 0x297A2D39)
BITS = 31
MASK = (1 << BITS) - 1
#: A count of samples is written with digits of this base, and each unit of digit k draws with mean ``BASE ** k``. Poisson
#: counts add up, so the sum of the draws has the whole count as its mean, exactly, whatever the count.
BASE_BITS = 3
BASE = 1 << BASE_BITS
#: The largest digit's place takes what is left, in as many units as it needs.
PLACES = 5


@functools.cache
def cumulative(mean: int) -> tuple[int, tuple[float, ...]]:
    """The least count that matters and, from it on, the probability of that count or fewer."""
    reach = int(9 * math.sqrt(mean)) + 9
    count, shares = max(0, mean - reach), []
    first, total = count, 0.0
    while count <= mean or (total < 1 - 1e-12 and count < mean + reach):
        total += math.exp(count * math.log(mean) - mean - math.lgamma(count + 1))
        shares.append(total)
        count += 1
    return first, tuple(shares)


@functools.cache
def _limits(mean: int) -> tuple[int, np.ndarray]:
    """The least count, and the random numbers from which on each larger one is drawn."""
    first, shares = cumulative(mean)
    limits = np.ceil(np.array(shares) * (1 << BITS) - 0.5)
    return first, limits[limits <= MASK].astype(np.uint32)


def counts(seeds: np.ndarray, replicates: np.ndarray, mean: int) -> np.ndarray:
    """A Poisson count for every seed (row) and replicate (column)."""
    mask = np.uint32(MASK)
    first, second, third = (np.uint32(m) for m in MIX)
    with np.errstate(over="ignore"):
        x = seeds.astype(np.uint32)[:, None] + replicates.astype(np.uint32)[None, :] * first
        x &= mask
        x ^= x >> np.uint32(15)
        x *= second
        x &= mask
        x ^= x >> np.uint32(12)
        x *= third
        x &= mask
        x ^= x >> np.uint32(15)
    least, limits = _limits(mean)
    if len(limits) > 16:
        return least + np.searchsorted(limits, x, side="right").astype(np.float64)
    drawn = np.zeros(x.shape, dtype=np.uint8)
    for limit in limits:
        drawn += x >= limit
    return least + drawn.astype(np.float64)


def quantile_sql(u: str, mean: str) -> str:
    """The Poisson count at ``u`` in SQL, for the means of all places."""
    branches = []
    for place in range(PLACES):
        least, shares = cumulative(BASE**place)
        steps = " ".join(f"WHEN {u} < {p:.17e} THEN {least + k}e0" for k, p in enumerate(shares))
        branches.append(f"WHEN {mean} = {BASE**place} THEN (CASE {steps} ELSE {least + len(shares)}e0 END)")
    return f"(CASE {' '.join(branches)} END)"
