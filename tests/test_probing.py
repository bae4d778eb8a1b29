"""Searches look prefixes up where the points are, and hash only what is asked for."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from nearfield.operators import adaptive, probing
from nearfield.plans.index import AnnIndex


def _vectors(spark, n=1200, dimensions=16, seed=7):
    x = np.random.default_rng(seed).normal(size=(n, dimensions))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")


def test_pairs_are_those_that_share_a_prefix(monkeypatch):
    """whatever the depths, few tables, sketches and how few rows are expanded at once."""
    rng = np.random.default_rng(1)
    queries, points, tables = 40, 70, 5
    h, p = rng.integers(0, 1 << 24, (queries, tables)), rng.integers(0, 1 << 24, (points, tables))
    p[:40] = h ^ rng.integers(0, 1 << 12, h.shape)
    depth, few = rng.choice([3, 8, 11, 12, 24], queries), rng.integers(0, tables + 1, queries)
    s, z, limit = rng.integers(0, 1 << 62, (queries, 2)), rng.integers(0, 1 << 62, (points, 2)), rng.integers(20, 40, queries)

    def shared(i, j, filtered):
        for t in range(tables):
            d = depth[j] + (t >= few[j])
            if d <= 24 and p[i, t] >> (24 - d) == h[j, t] >> (24 - d) and (not filtered or bin(z[i, t % 2] ^ s[j, t % 2]).count("1") <= limit[j]):
                yield t

    for hits in (1_000_000, 30):
        monkeypatch.setattr(probing, "HITS", hits)
        for filtered in (False, True):
            probe = probing.Probe(np.arange(queries), None, h, depth, few, *((s, limit) if filtered else ()))
            got = [(i, j) for row, own in probe.pairs(p.T.copy(), z if filtered else None) for i, j in zip(row.tolist(), own.tolist(), strict=True)]
            want = {(i, j) for i in range(points) for j in range(queries) if any(True for _ in shared(i, j, filtered))}
            assert len(got) == len(set(got)) and set(got) == want
    batch = pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["hashes"])
    counted = {q: w for out in probing._task_count(probing.Probe(np.arange(queries), None, h, depth, few))(iter([batch, batch.slice(0, 0)])) for q, w in zip(*out.to_pydict().values(), strict=True)}
    assert counted == {j: n for j in range(queries) if (n := sum(len(list(shared(i, j, False))) for i in range(points)))}


def test_a_search_joins_and_shuffles_no_table(spark, monkeypatch):
    """candidates come from one pass over the points, with the queries broadcast in several blocks too."""
    points = _vectors(spark)
    index = AnnIndex(spark, "angular", 16, num_tables=12, hash_function="simhash").insert(points).rebuild()
    asked = points.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    plans, made = [], adaptive.ranged_candidates

    def seen(*a):
        plans.append(made(*a))
        return plans[-1]

    monkeypatch.setattr(adaptive, "ranged_candidates", seen)
    want = sorted(map(tuple, index.search(asked, 3, 0.8, "none").collect()))
    shown = [p._jdf.queryExecution().toString() for p in plans]
    assert any("MapInArrow" in p for p in shown) and not any("Join" in p or "Exchange" in p or "Generate" in p for p in shown)
    from nearfield.operators import exact

    monkeypatch.setattr(exact, "QUERY_BYTES", 4096)
    assert sorted(map(tuple, index.search(asked, 3, 0.8, "none").collect())) == want


def test_sketches_are_made_when_a_filter_asks(spark, monkeypatch):
    """they were most of the hashing of sets; a search that filters makes them once."""
    from nearfield.operators import tables

    made = []
    monkeypatch.setattr(tables, "sketched", lambda df, *a, real=tables.sketched: made.append(df) or real(df, *a))
    points = _vectors(spark, 300)
    index = AnnIndex(spark, "angular", 16, num_tables=8, hash_function="simhash").insert(points).rebuild()
    asked = points.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    index.search(asked, 3, 0.5, "none").count()
    assert not made and "sketches" not in index.segments[0].columns
    assert index.built.where(F.size("sketches") == 32).count() == 300


def test_equal_sets_are_paired_by_all_hashes(spark, monkeypatch):
    """where the closest pairs are of equal sets, buckets of one table's hash, which common words fill, are not compared."""
    from nearfield.operators import exact

    rng = np.random.default_rng(2)
    sets = [sorted({1, 2, 3, *rng.choice(200, 3).tolist()}) for _ in range(150)] + [[400 + i, 500 + i] for i in range(12)] * 2
    points = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<int>")
    index = AnnIndex(spark, "jaccard", 1024, num_tables=16).insert(points).rebuild()
    want = sorted(map(tuple, index.closest_pairs_bf(10).collect()))
    monkeypatch.setattr(exact, "closest_pairs", None)  # any call fails
    assert sorted(map(tuple, index.closest_pairs(10, 0.9999).collect())) == want
    rounds = index.query_metrics().collect()
    assert len(rounds) == 1 and rounds[0].finished == 1 and rounds[0].candidates < 100


def test_sets_without_equals_are_paired_by_tables(spark):
    """a look at all hashes that finds too little leaves the rest to the tables."""
    sets = [[*range(20 * i, 20 * i + 19)] + [2500 + i] for i in range(100)] + [[*range(20 * i, 20 * i + 19)] for i in range(12)]
    points = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<int>")
    index = AnnIndex(spark, "jaccard", 4096, num_tables=32).insert(points).rebuild()
    assert sorted(map(tuple, index.closest_pairs(12, 0.9999).collect())) == sorted(map(tuple, index.closest_pairs_bf(12).collect()))
