"""Collision and failure probabilities, as plain functions and as column expressions.

s is a similarity in [0, 1], b a number of bits of one hash function, d a depth (bits of a prefix), L a
number of tables. A family gives P(b, s), the chance that two points of similarity s agree on b bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Collision = Callable[[int, float], float]
ColumnCollision = Callable[[int, Column], Column]
SKETCH_BITS = 64


def bits_for(n: int) -> int:
    """Bits that numbers below n take."""
    return max(0, n - 1).bit_length()


def simhash(b: int, s: float) -> float:
    return 1.0 if b <= 0 else 1.0 - math.acos(max(-1.0, min(1.0, 2 * s - 1))) / math.pi


def simhash_column(b: int, s: Column) -> Column:
    return F.lit(1.0) if b <= 0 else 1.0 - F.acos(F.least(F.greatest(2 * s - 1, F.lit(-1.0)), F.lit(1.0))) / math.pi


def minhash(universe: int) -> Collision:
    u = max(universe, 2)
    return lambda b, s: s + (1 - s) * ((u / min(2**b, u) - 1) / (u - 1))


def minhash_column(universe: int) -> ColumnCollision:
    u = max(universe, 2)
    return lambda b, s: s + (1 - s) * ((u / min(2**b, u) - 1) / (u - 1))


def concatenated(p: Collision, bits: int) -> Collision:
    """Of a concatenation of functions of so many bits: p(bits)^(d div bits) * p(d mod bits)."""

    def of(d: int, s: float) -> float:
        rest = p(d % bits, s) if d % bits else 1.0
        return p(bits, s) ** (d // bits) * rest

    return of


def concatenated_column(p: ColumnCollision, bits: int) -> ColumnCollision:
    def of(d: int, s: Column) -> Column:
        whole = F.pow(p(bits, s), F.lit(d // bits)) if d // bits else F.lit(1.0)
        return whole * p(d % bits, s) if d % bits else whole

    return of


def independent_failure(c: Collision, d: int, done: int, tables: int, s: float, deepest: int = 24) -> float:
    """Chance to miss a point when done tables have been looked at to depth d and the others to d + 1."""
    rest = 0 if d >= deepest else tables - done
    return (1 - c(d, s)) ** done * ((1 - c(d + 1, s)) ** rest if rest else 1.0)


def independent_failure_column(c: ColumnCollision, d: int, tables: int, s: Column, done: int | None = None, deepest: int = 24) -> Column:
    """The same as a column; done is tables if None."""
    done = tables if done is None else done
    rest = 0 if d >= deepest else tables - done
    missed = F.pow(1 - c(d, s), F.lit(done))
    return missed * F.pow(1 - c(d + 1, s), F.lit(rest)) if rest else missed


def tensor_failure_column(c: ColumnCollision, d: int, tables: int, s: Column) -> Column:
    """With all tables looked at to depth d, where a table pairs one of sqrt(tables) left halves with one of as many right halves."""
    side = math.isqrt(tables)
    left, right = (d + 1) // 2, d - (d + 1) // 2

    def some(p: Column) -> Column:
        return 1 - F.pow(1 - p, F.lit(side))

    return 1 - some(c(left, s)) * some(c(right, s))


def sketch_threshold(p: Collision, kth: float, bits: int = SKETCH_BITS) -> int:
    """Sketch bits that may differ at the kth similarity, halves rounded up."""
    return math.floor(bits * (1 - p(1, kth)) + 0.5)


def sketch_threshold_column(p: ColumnCollision, kth: Column, bits: int = SKETCH_BITS) -> Column:
    return F.round(bits * (1 - p(1, kth))).cast("int")
