"""Locality-sensitive hash families: seeded, batch-wise, with their collision probabilities.

A family object holds n functions. hash(batch) gives an integer matrix, a row for each point and a column
for each function. Vectors come as a matrix, sets as a flat token array with row starts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from nearfield.functions import probability
from nearfield.functions.numbers import Numbers, numbers


@dataclass
class Sets:
    """A batch of token sets: row i holds tokens[starts[i]:starts[i + 1]]."""

    tokens: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1


class SimHash:
    """The side of a random hyperplane; one bit."""

    metric = "angular"

    def __init__(self, n: int, dimensions: int, rng: Numbers | np.random.Generator, **_):
        planes = numbers(rng).normals(n, dimensions)
        self.planes = planes / np.linalg.norm(planes, axis=1, keepdims=True)

    @staticmethod
    def bits(dimensions: int) -> int:
        return 1

    @staticmethod
    def collision(dimensions: int, **_):
        return probability.simhash

    def hash(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.planes.T >= 0).astype(np.int64)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unnormalised Hadamard transform of the last axis, whose length is a power of two."""
    out = np.array(x, dtype=np.float64)
    n, half = out.shape[-1], 1
    while half < n:
        pairs = out.reshape(*out.shape[:-1], n // (2 * half), 2, half)
        low, high = pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]
        pairs[..., 0, :], pairs[..., 1, :] = low, high
        half *= 2
    return out


def closest_axis(x: np.ndarray) -> np.ndarray:
    """Number of the signed axis closest to each vector of the last axis; the sign is the highest bit."""
    at = np.abs(x).argmax(axis=-1)
    value = np.take_along_axis(x, at[..., None], axis=-1)[..., 0]
    return at + np.where(value < 0, x.shape[-1], 0)


class _CrossPolytopeBase:
    metric = "angular"

    @staticmethod
    def bits(dimensions: int) -> int:
        return probability.bits_for(dimensions) + 1

    @classmethod
    def collision(cls, dimensions: int, estimation_repetitions: int = 1000, estimation_eps: float = 5e-3, seed: int = 0, **_):
        return _estimate(dimensions, estimation_repetitions, estimation_eps, seed)


class CrossPolytopeEstimate:
    """Monte-Carlo collision probabilities on a grid of similarities; P(b, s) is read at the grid point below s."""

    def __init__(self, dimensions: int, repetitions: int = 1000, eps: float = 5e-3, seed: int = 0):
        rng = Numbers(seed, 77)
        size, self.eps = 1 << probability.bits_for(dimensions), eps
        self.bits = probability.bits_for(dimensions) + 1
        alphas = np.minimum(1.0, -1 + 2 * eps * np.arange(int(round(1 / eps)) + 1))
        self.table = np.ones((self.bits + 1, len(alphas)))
        for i, alpha in enumerate(alphas):
            z = rng.normals(2, repetitions, size)
            a, b = closest_axis(z[0]), closest_axis(alpha * z[0] + np.sqrt(max(0.0, 1 - alpha * alpha)) * z[1])
            for k in range(1, self.bits + 1):
                self.table[k, i] = (a >> (self.bits - k) == b >> (self.bits - k)).mean()

    def __call__(self, b: int, s: float) -> float:
        return float(self.table[b, min(self.table.shape[1] - 1, max(0, int(s / self.eps + 1e-9)))])


@lru_cache(maxsize=16)
def _estimate(dimensions: int, repetitions: int, eps: float, seed: int) -> CrossPolytopeEstimate:
    return CrossPolytopeEstimate(dimensions, repetitions, eps, seed)


class FHTCrossPolytope(_CrossPolytopeBase):
    """The closest axis after pseudo-random rotations: sign flips and Hadamard transforms."""

    def __init__(self, n: int, dimensions: int, rng: Numbers | np.random.Generator, num_rotations: int = 3, **_):
        self.size = 1 << probability.bits_for(dimensions)
        self.signs = numbers(rng).signs(n, num_rotations, self.size)

    def hash(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.size))
        padded[:, : x.shape[1]] = x
        out = np.empty((len(x), len(self.signs)), dtype=np.int64)
        # short transforms are products with a small matrix, many functions at a time
        turned = (lambda y: y @ hadamard(np.eye(self.size))) if self.size <= 256 else hadamard
        step = max(1, 1_000_000 // max(1, len(x) * self.size))
        for f in range(0, len(self.signs), step):
            some = self.signs[f : f + step]
            y = padded[:, None, :]
            for r in range(some.shape[1]):
                y = turned(y * some[:, r])
            out[:, f : f + step] = closest_axis(y)
        return out


class CrossPolytope(_CrossPolytopeBase):
    """The closest axis after a multiplication with random unit rows."""

    def __init__(self, n: int, dimensions: int, rng: Numbers | np.random.Generator, **_):
        rows = numbers(rng).normals(n, 1 << probability.bits_for(dimensions), dimensions)
        self.rows = rows / np.linalg.norm(rows, axis=2, keepdims=True)

    def hash(self, x: np.ndarray) -> np.ndarray:
        return np.stack([closest_axis(x @ r.T) for r in self.rows], axis=1)


class Tabulation:
    """64-bit hashes of 32-bit tokens: the exclusive or of one table entry for each byte."""

    def __init__(self, tables: np.ndarray):
        self.tables = tables

    @classmethod
    def some(cls, n: int, rng: Numbers) -> list[Tabulation]:
        return [cls(t) for t in rng.words64(n, 4, 256)]

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        t = tokens.astype(np.uint32)
        out = self.tables[0][t & 255]
        for i in range(1, 4):
            out = out ^ self.tables[i][(t >> np.uint32(8 * i)) & 255]
        return out


#: Entries of the tables of ranks that MinHash functions of a small universe are looked up in.
RANKED = 1 << 24


class MinHash:
    """The token of smallest hash, its low bits permuted; an empty set hashes to 0."""

    metric = "jaccard"

    def __init__(self, n: int, universe: int, rng: Numbers | np.random.Generator, randomized_bits: int = 4, **_):
        rng = numbers(rng)
        self.hashes = Tabulation.some(n, rng)
        self.width = min(randomized_bits, probability.bits_for(max(universe, 2)))
        self.permutations = list(rng.permutations(n, 1 << self.width))
        self.universe, self.columns, self.table = universe, np.arange(n), None

    def __getstate__(self) -> dict:
        """Without the ranks, which each process makes for itself."""
        return self.__dict__ | {"table": None}

    def _ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """The place of each token of the universe in each function's order, and the function's value by place."""
        if self.table is None:
            every, low = np.arange(self.universe, dtype=np.int64), (1 << self.width) - 1
            ranks, values = (np.empty((self.universe, len(self.hashes)), np.uint16) for _ in range(2))
            for f, (h, permutation) in enumerate(zip(self.hashes, self.permutations, strict=True)):
                order = np.argsort(h(every) >> np.uint64(32), kind="stable")  # equal hashes by token
                ranks[order, f] = every
                values[:, f] = (order & ~low) | permutation[order & low]
            self.table = ranks, values
        return self.table

    @staticmethod
    def bits(universe: int) -> int:
        return probability.bits_for(max(universe, 2))

    @staticmethod
    def collision(universe: int, **_):
        return probability.minhash(universe)

    def hash(self, sets: Sets) -> np.ndarray:
        out = np.zeros((len(sets), len(self.hashes)), dtype=np.int64)
        full = np.flatnonzero(np.diff(sets.starts))
        if not len(full):
            return out
        if self.universe * len(self.hashes) <= RANKED and sets.tokens.max() < self.universe <= 1 << 16:
            ranks, values = self._ranked()
            for i in full:
                tokens = sets.tokens[sets.starts[i] : sets.starts[i + 1]]
                least = ranks[tokens[:1024]].min(axis=0)
                for at in range(1024, len(tokens), 1024):
                    least = np.minimum(least, ranks[tokens[at : at + 1024]].min(axis=0))
                out[i] = values[least, self.columns]
            return out
        # hashes of distinct tokens only; a key orders by the hash's upper half, then by token, and holds the token
        distinct, place = np.unique(sets.tokens, return_inverse=True)
        starts, low = sets.starts[:-1][full], (1 << self.width) - 1
        for f, (h, permutation) in enumerate(zip(self.hashes, self.permutations, strict=True)):
            keys = h(distinct) >> np.uint64(32) << np.uint64(32) | distinct.astype(np.uint64)
            least = (np.minimum.reduceat(keys[place], starts) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            out[full, f] = (least & ~low) | permutation[least & low]
        return out


class MinHash1Bit(MinHash):
    """The lowest bit of a MinHash."""

    @staticmethod
    def bits(universe: int) -> int:
        return 1

    @staticmethod
    def collision(universe: int, **_):
        p = probability.minhash(universe)
        return lambda b, s: p(min(b, 1), s)

    def hash(self, sets: Sets) -> np.ndarray:
        return super().hash(sets) & 1


FAMILIES = {"simhash": SimHash, "crosspolytope": CrossPolytope, "fht_crosspolytope": FHTCrossPolytope, "minhash": MinHash, "1bit_minhash": MinHash1Bit}
DEFAULT_HASH = {"angular": "fht_crosspolytope", "jaccard": "minhash"}
DEFAULT_SKETCH = {"angular": "simhash", "jaccard": "1bit_minhash"}


def sketch_family(metric: str, name: str | None = None):
    """The family of a sketch's bits: one whose hashes have one bit."""
    kind = family(metric, name or DEFAULT_SKETCH.get(metric))
    if kind.bits(2) != 1:
        raise ValueError(f"{name!r} has no hashes of one bit")
    return kind


def family(metric: str, name: str | None):
    """The family of a name, checked against the metric."""
    if metric not in DEFAULT_HASH:
        raise ValueError(f"unknown metric {metric!r}")
    name = name or DEFAULT_HASH[metric]
    if name not in FAMILIES or FAMILIES[name].metric != metric:
        raise ValueError(f"no hash function {name!r} for {metric}")
    return FAMILIES[name]
