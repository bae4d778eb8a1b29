"""Numbers that look random and that any engine can compute: a 32-bit mixer over a counter.

All constants of hash families come from here, so that a saved index needs no function tables and SQL can
recompute each hash. A stream is named by a seed and a number; its i-th value is mix(mix(i) ^ key).
"""

from __future__ import annotations

import numpy as np

LOW = np.uint64(0xFFFFFFFF)
#: Fixed values of the 32-bit finalising mixer of MurmurHash3 (public domain).
FIRST, SECOND = np.uint64(0x85EBCA6B), np.uint64(0xC2B2AE35)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = ((x ^ (x >> np.uint64(16))) * FIRST) & LOW
    x = ((x ^ (x >> np.uint64(13))) * SECOND) & LOW
    return x ^ (x >> np.uint64(16))


def key_of(seed: int, stream: int) -> np.uint64:
    return mix(mix(np.array([seed & 0xFFFFFFFF])) ^ np.uint64(stream))[0]


class Numbers:
    """A stream and the place reached in it."""

    def __init__(self, seed: int, stream: int):
        self.key, self.at = key_of(seed, stream), 0

    def words(self, n: int) -> np.ndarray:
        """The next n values, of 32 bits each."""
        first, self.at = self.at, self.at + n
        return mix(mix(np.arange(first, self.at, dtype=np.uint64)) ^ self.key)

    def words64(self, *shape: int) -> np.ndarray:
        pairs = self.words(2 * int(np.prod(shape))).reshape(*shape, 2)
        return (pairs[..., 0] << np.uint64(32)) | pairs[..., 1]

    def normals(self, *shape: int) -> np.ndarray:
        """Standard normal numbers, each of two values."""
        pairs = (self.words(2 * int(np.prod(shape))).reshape(*shape, 2) + 0.5) / 4294967296.0
        return np.sqrt(-2 * np.log(pairs[..., 0])) * np.cos(2 * np.pi * pairs[..., 1])

    def signs(self, *shape: int) -> np.ndarray:
        return 1.0 - 2.0 * (self.words(int(np.prod(shape))).reshape(shape) & np.uint64(1))

    def below(self, n: int, *shape: int) -> np.ndarray:
        return (self.words(int(np.prod(shape))) % np.uint64(n)).astype(np.int64).reshape(shape)

    def permutations(self, count: int, n: int) -> np.ndarray:
        """count permutations of range(n): the order of n values, equal ones by place."""
        return np.argsort(self.words(count * n).reshape(count, n), axis=1, kind="stable")


def numbers(source: Numbers | np.random.Generator) -> Numbers:
    """A stream, or one that starts from a generator's next number."""
    return source if isinstance(source, Numbers) else Numbers(int(source.integers(1 << 31)), 0)
