"""Exact search and pairs do no more than they must, within bounded memory, and give brute force's rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from nearfield.operators import exact


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0


def brute_pairs(rows, k, similar):
    pairs = [(similar(x, y), i, j) for i, x in rows for j, y in rows if i < j]
    return [(i, j, round(s, 9)) for s, i, j in sorted((p for p in pairs if p[0] > 0), key=lambda p: (-p[0], -p[1], -p[2]))[:k]]


def pairs_of(df):
    return [(r.id_a, r.id_b, round(r.similarity, 9)) for r in df.orderBy("rank").collect()]


def test_equal_sets_are_paired_without_comparing_all(spark, monkeypatch):
    """k equal pairs are the result; no task compares blocks."""
    rows = [(i, sorted({i % 7, (i * i) % 11, 20 + i % 3})) for i in range(120)] + [(200, []), (201, [])]
    points = spark.createDataFrame(rows, "id long, tokens array<int>")

    def unused(*a):
        raise AssertionError("blocks are compared")

    monkeypatch.setattr(exact, "_task_pairs", unused)
    assert pairs_of(exact.closest_pairs(points, 10, "jaccard", "tokens")) == brute_pairs(rows, 10, jaccard)


def test_few_equal_sets_and_repeated_tokens(spark):
    rows = [(i, [i % 13, 30 + i % 17, 60 + i % 19]) for i in range(150)] + [(300, [1, 2, 2]), (301, [2, 1]), (302, None)]
    points = spark.createDataFrame(rows, "id long, tokens array<int>")
    assert pairs_of(exact.closest_pairs(points, 10, "jaccard", "tokens", block=20)) == brute_pairs([(i, t) for i, t in rows if t is not None], 10, jaccard)


def test_comparing_sets_takes_bounded_memory():
    """words of half the sets are a product, rare ones lists taken a part at a time."""
    rng = np.random.default_rng(1)
    sets = [np.flatnonzero(rng.random(400) < 0.5).tolist() + [1000 + i % 300] for i in range(1000)]
    points = pa.array(sets, pa.list_(pa.int32()))
    block = exact.Block("jaccard", np.arange(1000), points)
    tracemalloc.start()
    sims = block.similarities(points)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    for i, j in ((0, 0), (3, 303), (10, 999), (500, 20)):
        assert sims[i, j] == pytest.approx(jaccard(sets[i], sets[j]), abs=1e-12)


def test_lists_of_rare_tokens_are_cut(monkeypatch):
    monkeypatch.setattr(exact, "CELLS", 7)
    monkeypatch.setattr(exact, "COMMON", 2)
    sets = [[i % 3, 5 + i % 4, 10 + i % 5] for i in range(40)] + [[]]
    points = pa.array(sets, pa.list_(pa.int32()))
    sims = exact.Block("jaccard", np.arange(41), points).similarities(points)
    assert np.allclose(sims, [[jaccard(a, b) for b in sets] for a in sets])


@pytest.mark.parametrize("metric", ["angular", "l2"])
@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e18, 1e40])
def test_scores_lose_no_neighbour(metric, scale, monkeypatch):
    """single-precision scores only choose; copies and near copies keep their order by similarity, then id."""
    monkeypatch.setattr(exact, "CELLS", 500)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[100:200] = x[:100] + 1e-9 * rng.normal(size=(100, 8))
    x[200:250] = x[:50]
    x *= scale
    ids, asked = np.arange(300), x[:20]
    block = exact.Block(metric, np.arange(1000, 1020), pa.array(asked.tolist(), pa.list_(pa.float64())))
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 70]), pa.array(x[i : i + 70].tolist(), pa.list_(pa.float64()))], names=["id", "features"]) for i in range(0, 300, 70)]
    out = list(exact._task_knn(block, 5, False)(iter(batches)))[0].to_pydict()
    unit = lambda v: v / np.linalg.norm(v)
    for q in range(20):
        sims = [np.clip((unit(asked[q]) @ unit(v) + 1) / 2, 0, 1) if metric == "angular" else 1 / (1 + ((asked[q] - v) ** 2).sum()) for v in x]
        want = sorted((s for s in sims if s > 0), reverse=True)[:5]
        got = [s for p, s in zip(out["query_id"], out["similarity"], strict=True) if p == 1000 + q]
        assert np.allclose(got, want, rtol=1e-9, atol=1e-12)


def test_pairs_of_blocks_are_spread(spark):
    """Spark may not put pairs of blocks of few bytes into one task."""
    points = spark.range(400).selectExpr("id", "array(cast(id as double), sin(id)) as features")
    plan = exact.closest_pairs(points, 3, "l2", block=50)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan
