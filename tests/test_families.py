import math

import numpy as np
import pytest

from nearfield.functions import probability
from nearfield.operators import families, hash_sources

rng = np.random.default_rng(5)


def pair_of_similarity(n, dimensions, cosine):
    a = rng.standard_normal((n, dimensions))
    b = cosine * a + math.sqrt(1 - cosine**2) * rng.standard_normal((n, dimensions))
    return a, b


@pytest.mark.parametrize("name", ["simhash", "crosspolytope", "fht_crosspolytope"])
def test_angular_collision_probability(name):
    family = families.family("angular", name)
    a, b = pair_of_similarity(3000, 16, 0.7)
    made = family(4, 16, np.random.default_rng(1))
    agree = (made.hash(a) == made.hash(b)).mean()
    c = (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
    p = family.collision(16)
    assert agree == pytest.approx(np.mean([p(family.bits(16), (x + 1) / 2) for x in c]), abs=0.04)


@pytest.mark.parametrize("name", ["minhash", "1bit_minhash"])
def test_jaccard_collision_probability(name):
    family = families.family("jaccard", name)
    made = family(800, 100, np.random.default_rng(2))
    sets = families.Sets(np.array([0, 1, 2, 3, 4, 5, 2, 3, 4, 5, 6, 7]), np.array([0, 6, 12]))
    h = made.hash(sets)
    assert (h[0] == h[1]).mean() == pytest.approx(family.collision(100)(family.bits(100), 0.5), abs=0.05)


def test_minhash_formula():
    p = probability.minhash(100)
    assert p(7, 0.3) == pytest.approx(0.3)
    assert p(1, 0.5) == pytest.approx(0.5 + 0.5 * 49 / 99)


def test_hadamard_is_its_own_inverse():
    x = rng.standard_normal((3, 8))
    assert np.allclose(families.hadamard(families.hadamard(x)), 8 * x)
    assert families.hadamard(np.eye(4)).tolist() == [[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]]
    assert families.closest_axis(np.array([[0, 0, 0, 0], [0, -3, 1, 3], [1, 0, 2, 0]])).tolist() == [0, 5, 2]


@pytest.mark.parametrize("source", ["independent", "pool", "tensor"])
def test_hashes_use_every_bit(source):
    made = hash_sources.source_class(source)(families.SimHash, 100, 100, 3, depth=24)
    h = made.hash(rng.standard_normal((60, 100)))
    assert h.shape == (60, 100) and h.min() >= 0 and h.max() < 1 << 24
    assert np.bitwise_or.reduce(h.ravel()) == (1 << 24) - 1


def test_failure_falls_with_depth_and_tensor_formula_agrees():
    made = hash_sources.Independent(families.SimHash, 16, 10, 1)
    values = [made.failure(d, 0.8) for d in range(24, 0, -1)]
    assert values == sorted(values, reverse=True)
    t = hash_sources.Tensor(families.SimHash, 16, 9, 1)
    c = t.collision
    assert t.failure(6, 0.8) == pytest.approx(1 - (1 - (1 - c(3, 0.8)) ** 3) ** 2)
    assert t.failure(6, 0.8) <= t.failure(6, 0.8, 4) <= t.failure(7, 0.8)
    assert made.failure(12, 0.8) < made.failure(12, 0.8, 4) < made.failure(13, 0.8)


def test_grid_pairs_cover_the_grid():
    assert [hash_sources.grid_pair(i) for i in range(9)] == [(0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (1, 2), (2, 0), (2, 1), (2, 2)]
    assert len({hash_sources.grid_pair(i) for i in range(100)}) == 100


def test_sketch_threshold():
    assert probability.sketch_threshold(probability.simhash, 1.0) == 0
    assert probability.sketch_threshold(probability.simhash, 0.0) == 64


def test_table_choice():
    fit = hash_sources.tables_for(10_000_000, 500, 32, families.SimHash, 16)
    assert fit > 1 and hash_sources.tables_for(20_000_000, 500, 32, families.SimHash, 16) > fit
    with pytest.raises(ValueError):
        hash_sources.tables_for(1000, 500, 32, families.SimHash, 16)


def test_wrong_names():
    for call in (lambda: families.family("angular", "minhash"), lambda: families.family("euclid", None), lambda: hash_sources.source_class("none")):
        with pytest.raises(ValueError):
            call()
