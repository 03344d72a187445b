"""A keyed permutation of the numbers 0 … n - 1, as plain integer arithmetic.

A number is a pair of digits (left below a, right below b, a * b just over n).  Rounds add a keyed
hash of one digit to the other, which can be undone, so distinct numbers stay distinct.  A result
beyond n is permuted again until it lies below: the walk stays on the cycle of its start, so
numbers below n stay distinct too.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a prime whose squares fit a signed 64-bit integer.
PRIME = 2_147_483_647
ROUNDS = 4
# Cells beyond n are fewer than the root of n, so a walk of so many steps never occurs in practice; it would fail.
MOST_STEPS = 64


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0 … n - 1 chosen by ``seed``."""

    n: int
    seed: int

    @property
    def left(self) -> int:
        return max(1, math.isqrt(max(self.n - 1, 0)) + 1)

    @property
    def right(self) -> int:
        return max(1, -(-self.n // self.left))

    def keys(self) -> list[tuple[int, int]]:
        """Two numbers for each round."""
        out = []
        for r in range(ROUNDS):
            digest = hashlib.md5(f"{self.seed}:{r}".encode()).digest()
            out.append(tuple(int.from_bytes(digest[i : i + 4], "big") % PRIME for i in (0, 4)))
        return out

    def once(self, x: int) -> int:
        left, right = divmod(x, self.right)
        for a, b in self.keys():
            left = (left + ((right + a) % PRIME) ** 2 % PRIME) % self.left
            right = (right + ((left + b) % PRIME) ** 2 % PRIME) % self.right
        return left * self.right + right

    def of(self, x: int) -> int:
        """Where a number goes."""
        x = self.once(x)
        while x >= self.n:
            x = self.once(x)
        return x

    def column(self, x: Column) -> Column:
        """The same for a column of numbers below n."""
        big = lambda v: F.lit(v).cast("long")
        rounds = F.array(*[F.struct(big(a).alias("a"), big(b).alias("b")) for a, b in self.keys()])

        def square(v: Column) -> Column:
            low = F.pmod(v, big(PRIME))
            return F.pmod(low * low, big(PRIME))

        def half(state: Column, key: Column) -> Column:
            return F.pmod(state["l"] + square(state["r"] + key["a"]), big(self.left))

        def step(state: Column, key: Column) -> Column:
            right = F.pmod(state["r"] + square(half(state, key) + key["b"]), big(self.right))
            return F.struct(half(state, key).alias("l"), right.alias("r"))

        def once(value: Column) -> Column:
            start = F.struct(F.floor(value / self.right).cast("long").alias("l"), F.pmod(value, big(self.right)).alias("r"))
            return F.aggregate(rounds, start, step, lambda s: s["l"] * self.right + s["r"])

        outside = self.left * self.right - self.n
        walk = F.sequence(F.lit(1), F.lit(min(outside + 1, MOST_STEPS)))
        found = F.aggregate(walk, once(x.cast("long")), lambda v, _: F.when(v >= self.n, once(v)).otherwise(v))
        return F.when(found < self.n, found).otherwise(F.raise_error(F.lit("a walk of the permutation is too long")).cast("long"))
