"""How the hashes of many tables are put together from hash functions: independent, pooled or tensored."""

from __future__ import annotations

import math

import numpy as np

from nearfield.functions import probability
from nearfield.functions.numbers import Numbers

from .families import Sets

DEPTH = 24


def joined(parts: np.ndarray, bits: int, total: int) -> np.ndarray:
    """Function values of the last axis as one number of total bits, the first value highest, the rest cut off."""
    out = np.zeros(parts.shape[:-1], dtype=np.int64)
    for i in range(parts.shape[-1]):
        out = out << bits | parts[..., i]
    return out >> (parts.shape[-1] * bits - total)


def spread_bits(x: np.ndarray) -> np.ndarray:
    """Zeros between the bits: abc becomes 0a0b0c."""
    x = np.asarray(x, dtype=np.int64)
    out = np.zeros_like(x)
    for i in range(31):
        out |= (x >> i & 1) << 2 * i
    return out


def grid_pair(i: int) -> tuple[int, int]:
    """The i-th pair of the grid in shells: (0,0) (0,1) (1,0) (1,1) (0,2) (1,2) (2,0) (2,1) (2,2) ..."""
    shell = math.isqrt(i)
    k = i - shell * shell
    return (k, shell) if k < shell else (shell, k - shell)


class Source:
    """Hashes of DEPTH bits for every table. bits: of one function; space: dimensions or universe."""

    name = ""

    def __init__(self, family, space: int, tables: int, seed: int, args: dict | None = None, depth: int = DEPTH):
        self.family, self.space, self.tables, self.depth, self.args = family, space, tables, depth, args or {}
        self.bits = family.bits(space)
        self.each = -(-depth // self.bits)
        self.rng = Numbers(seed, 1)
        self.collision = probability.concatenated(family.collision(space, seed=seed, **self.args), self.bits)

    def __getstate__(self) -> dict:
        """Without the probabilities, which executors don't need."""
        return {k: v for k, v in self.__dict__.items() if k != "collision"}

    def functions(self, n: int):
        return self.family(n, self.space, self.rng, **self.args)

    def hash(self, batch: np.ndarray | Sets) -> np.ndarray:
        raise NotImplementedError

    def failure(self, depth: int, s: float, done: int | None = None) -> float:
        """Chance to miss a point of similarity s with done tables looked at to depth (all if None), the others one bit deeper."""
        return probability.independent_failure(self.collision, depth, self.tables if done is None else done, self.tables, s, self.depth)

    @classmethod
    def function_count(cls, family, space: int, tables: int, depth: int = DEPTH, **_) -> int:
        raise NotImplementedError


class Independent(Source):
    """Fresh functions for each table."""

    name = "independent"

    def __init__(self, *a, **b):
        super().__init__(*a, **b)
        self.made = self.functions(self.each * self.tables)

    @classmethod
    def function_count(cls, family, space, tables, depth=DEPTH, **_):
        return -(-depth // family.bits(space)) * tables

    def hash(self, batch):
        return joined(self.made.hash(batch).reshape(len(batch), self.tables, self.each), self.bits, self.depth)


class Pool(Source):
    """A pool of functions; each table draws from it with replacement."""

    name = "pool"

    def __init__(self, *a, pool_size: int = 3000, **b):
        super().__init__(*a, **b)
        n = pool_size // self.bits
        if n < 1:
            raise ValueError("the pool holds no function")
        self.made = self.functions(n)
        self.drawn = self.rng.below(n, self.tables, self.each)

    @classmethod
    def function_count(cls, family, space, tables, depth=DEPTH, pool_size=3000, **_):
        return pool_size // family.bits(space)

    def hash(self, batch):
        return joined(self.made.hash(batch)[:, self.drawn], self.bits, self.depth)


class Tensor(Source):
    """Two groups of half hashes; table i pairs one of each group and interleaves their bits."""

    name = "tensor"

    def __init__(self, *a, **b):
        super().__init__(*a, **b)
        self.side = math.isqrt(self.tables - 1) + 1 if self.tables else 0
        self.half = (self.depth + 1) // 2
        self.per_half = -(-self.half // self.bits)
        self.made = self.functions(self.per_half * 2 * self.side)
        self.pairs = np.array([grid_pair(i) for i in range(self.tables)]).reshape(-1, 2)

    @classmethod
    def function_count(cls, family, space, tables, depth=DEPTH, **_):
        return -(-((depth + 1) // 2) // family.bits(space)) * 2 * (math.isqrt(max(0, tables - 1)) + 1)

    def hash(self, batch):
        halves = joined(self.made.hash(batch).reshape(len(batch), 2, self.side, self.per_half), self.bits, self.half)
        left, right = spread_bits(halves[:, 0]), spread_bits(halves[:, 1])
        both = left[:, self.pairs[:, 0]] << 1 | right[:, self.pairs[:, 1]]
        return both >> (2 * self.half - self.depth)

    def failure(self, depth: int, s: float, done: int | None = None) -> float:
        """At most: a point is found if a pair of halves meets in the square of done tables, or one bit deeper among all."""

        def missed(d: int, side: int) -> float:
            some = lambda bits: 1 - (1 - self.collision(bits, s)) ** side
            return 1 - some((d + 1) // 2) * some(d // 2)

        whole = math.isqrt(self.tables)
        if done is None or done >= self.tables:
            return missed(depth, whole)
        deeper = 1.0 if depth >= self.depth else missed(depth + 1, whole)
        return min(deeper, missed(depth, math.isqrt(done)))


SOURCES = {c.name: c for c in (Independent, Pool, Tensor)}


def source_class(name: str | None):
    if (name or "independent") not in SOURCES:
        raise ValueError(f"unknown hash source {name!r}")
    return SOURCES[name or "independent"]


#: Bytes of the memory model: sketches of a point, an entry of a table, a table's directory and margins.
SKETCH_BYTES = 256
ENTRY_BYTES = 8
DIRECTORY_BYTES = 4 * (2**13 + 1) + ENTRY_BYTES * 24


def function_bytes(family, space: int) -> int:
    if family.metric == "jaccard":
        return 4 * 256 * 8 + 16
    padded = 1 << probability.bits_for(space)
    return {"SimHash": 2 * space, "FHTCrossPolytope": 3 * padded, "CrossPolytope": 2 * padded * space}[family.__name__]


def tables_within(memory_limit: int, points: int, point_bytes: int, family, space: int, source=Independent, **args) -> int:
    """The most tables for which points, sketches, functions and tables stay below the limit.

    Where the points alone do not, the tables that are lacking, as a negative number: the sum goes on below zero.
    """
    fixed = points * (point_bytes + SKETCH_BYTES)

    def size(n: int) -> int:
        made = source.function_count(family, space, abs(n), **args) * (1 if n >= 0 else -1)
        return fixed + made * function_bytes(family, space) + n * (DIRECTORY_BYTES + ENTRY_BYTES * points)

    low, high = 0, 1
    while size(low) >= memory_limit:
        low, high = 2 * low - 1, low
    while size(high) < memory_limit:
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if size(middle) < memory_limit else (low, middle)
    return low


def tables_for(memory_limit: int, points: int, point_bytes: int, family, space: int, source=Independent, **args) -> int:
    """The same for an index, which needs a table at least."""
    n = tables_within(memory_limit, points, point_bytes, family, space, source, **args)
    if n < 1:
        raise ValueError("insufficient memory")
    return n
