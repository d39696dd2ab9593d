"""A keyed permutation of the numbers 0 to n - 1 that is computed either way in constant time.

A number is written as x * b + y, with x below a and y below b, where a * b is the least such rectangle of about equal
sides. Each round adds a hash of one half to the other half, which can be undone (a Feistel network on numbers of any
range). Where the result lies beyond n - 1, the steps go on until it does not; the rectangle has fewer than sqrt(n) + 1
numbers too many, so all walks over these are known beforehand, and with them the number of steps that always suffices.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from edulake.functions.hashing import HASH_BITS, hash52

ROUNDS = 4


def sides(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


class Permutation:
    """The permutation of ``n`` numbers that ``tag`` names."""

    def __init__(self, n: int, tag: str):
        if n >= 1 << HASH_BITS:
            raise ValueError(f"more than 2^{HASH_BITS} numbers")
        self.n, self.tag = n, tag
        self.a, self.b = sides(n)
        # The longest walk over numbers beyond n - 1; a walk back has the same length.
        self.walk = 0
        for beyond in range(n, self.a * self.b):
            steps, at = 1, self._step(beyond)
            while n <= at and at != beyond:
                steps, at = steps + 1, self._step(at)
            self.walk = max(self.walk, steps)

    def _hash(self, turn: int, half: int) -> int:
        text = f"permutation|{self.tag}|{turn}|{half}"
        return int(hashlib.md5(text.encode()).hexdigest()[: HASH_BITS // 4], 16)

    def _step(self, number: int) -> int:
        x, y = divmod(number, self.b)
        for turn in range(ROUNDS):
            if turn % 2 == 0:
                x = (x + self._hash(turn, y)) % self.a
            else:
                y = (y + self._hash(turn, x)) % self.b
        return x * self.b + y

    def _step_back(self, number: int) -> int:
        x, y = divmod(number, self.b)
        for turn in reversed(range(ROUNDS)):
            if turn % 2 == 0:
                x = (x - self._hash(turn, y)) % self.a
            else:
                y = (y - self._hash(turn, x)) % self.b
        return x * self.b + y

    def place(self, number: int) -> int:
        """Where a number goes."""
        at = self._step(number)
        while at >= self.n:
            at = self._step(at)
        return at

    def number(self, place: int) -> int:
        """The number that goes to a place."""
        at = self._step_back(place)
        while at >= self.n:
            at = self._step_back(at)
        return at

    def _column(self, column: Column, back: bool) -> Column:
        a, b = F.lit(self.a).cast("bigint"), F.lit(self.b).cast("bigint")

        def step(p: Column) -> Column:
            y = F.pmod(p, b)
            # Exact while the difference has 53 bits.
            x = ((p - y) / b).cast("bigint")
            for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = F.lit(-1 if back else 1)
                if turn % 2 == 0:
                    x = F.pmod(x + sign * hash52("permutation", self.tag, str(turn), y), a)
                else:
                    y = F.pmod(y + sign * hash52("permutation", self.tag, str(turn), x), b)
            return x * b + y

        return self._walk(column, step)

    def _walk(self, column: Column, step: Callable[[Column], Column]) -> Column:
        """The first step, and further ones where it leads beyond n - 1. Every result is bound once."""
        bound = F.transform(F.array(column.cast("bigint")), step)
        for _ in range(self.walk):
            bound = F.transform(bound, lambda p: F.when(p < self.n, p).otherwise(step(p)))
        return bound[0]

    def place_column(self, number: Column) -> Column:
        return self._column(number, back=False)

    def number_column(self, place: Column) -> Column:
        return self._column(place, back=True)
