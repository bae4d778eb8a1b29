"""Steps that grew faster than their tables, or broke on large ones."""

import numpy as np
import pyarrow as pa
import pytest

from nearfield.functions import formats
from nearfield.functions.numbers import Numbers
from nearfield.operators import families, relational
from nearfield.plans import catalog


def test_texts_become_sets_in_batches(spark):
    """the same sets as the expression's, null and odd texts too."""
    texts = [(1, "The cat, the CAT; a hat-2"), (2, ""), (3, None), (4, "ÄB cK İx ß9 _z"), (5, " \n"), (6, "a" * 5000 + " b")]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {r.id: r.tokens for r in formats.text_sets(df, 4096).collect()}
    from pyspark.sql import functions as F

    want = {r.id: r.tokens for r in df.select("id", formats.text_tokens(F.col("text"), 4096).alias("tokens")).collect()}
    assert got == want
    assert "MapInArrow" in catalog.doc_sets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_minhash_by_rank_is_minhash(monkeypatch):
    """functions of a small universe are looked up, also for sets above 1,024 tokens and empty ones."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(4096, n, replace=False)) for n in (1, 3000, 0, 50, 1025, 0)]
    sets = families.Sets(np.concatenate(rows).astype(np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    for kind in (families.MinHash, families.MinHash1Bit):
        made = kind(40, 4096, Numbers(42, 1))
        fast = made.hash(sets)
        assert made.table is not None and made.__getstate__()["table"] is None
        monkeypatch.setattr(families, "RANKED", 0)
        assert (kind(40, 4096, Numbers(42, 1)).hash(sets) == fast).all()
        monkeypatch.undo()


def test_minhash_tables_shuffle_no_tokens(spark):
    """sets of one id count as one, empty ones not; what is shuffled is a row for each set and table."""
    sets = spark.createDataFrame([(1, [5, 9]), (1, [70]), (2, []), (3, None), (4, [9, None])], "id long, tokens array<int>")
    df = relational.minhash_tables(sets, 3)
    import hashlib

    h = lambda t, x: int(hashlib.md5(f"42:{t}:{x}".encode()).hexdigest()[:8], 16)
    want = {(t, i, *min((h(t, x), x) for x in xs)) for t in range(3) for i, xs in ((1, (5, 9, 70)), (4, (9,)))}
    assert {(r.table_id, r.id, r.hash, r.token) for r in df.collect()} == want
    plan = df._jdf.queryExecution().toString()
    assert "Join" not in plan and "Generate" not in plan


def _near(spark, n=1500, dimensions=16):
    """Pairs of close vectors and sets, with ids 2 i and 2 i + 1."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n // 2, dimensions))
    y = x + 1e-3 * rng.normal(size=x.shape)
    return spark.createDataFrame([(2 * i + j, v.tolist()) for i in range(n // 2) for j, v in enumerate((x[i], y[i]))], "id long, features array<double>")


def test_close_neighbours_are_found_by_whole_hashes(spark, monkeypatch):
    """Where whole hashes suffice, no bucket of a few points for each table is gathered."""
    from nearfield.operators import adaptive, tables
    from nearfield.plans.index import AnnIndex

    points = _near(spark)
    index = AnnIndex(spark, "angular", 16, num_tables=48, hash_function="simhash").insert(points).rebuild()
    asked = points.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    looked = []

    def candidates(rows, *a, real=tables.ranged_candidates):
        looked.append([r.depth for r in rows.select("depth").distinct().collect()])
        return real(rows, *a)

    monkeypatch.setattr(adaptive, "ranged_candidates", candidates)
    found = {(r.query_id, r.id) for r in index.search(asked, 2, 0.99, "none").collect()}
    assert found == {(i, j) for i in range(0, 1500, 20) for j in (i, i + 1)}
    assert looked[0] == [24] and all(d > adaptive.start_depth(1500) for some in looked for d in some)


@pytest.mark.parametrize("stored", ["double", "q15"])
def test_candidates_are_compared_in_batches(stored):
    """the similarities of vectors and of codes, a zero vector and a similarity of 0 among them."""
    from nearfield.operators import adaptive

    rng = np.random.default_rng(5)
    p, q = rng.integers(-9, 9, (50, 6)), rng.integers(-9, 9, (50, 6))
    p[3] = 0
    q[4] = -p[4]
    if stored == "double":
        p, q = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9) for x in (p, q))
    kind = pa.list_(pa.int16() if stored == "q15" else pa.float64())
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(range(50)), pa.array(p.tolist(), kind), pa.array(q.tolist(), kind)], names=["query_id", "id", "p", "q"])
    got = {i: s for out in adaptive._task_compare("angular", stored)(iter([batch])) for i, s in zip(out.to_pydict()["id"], out.to_pydict()["similarity"], strict=True)}
    for i in range(50):
        n = np.linalg.norm(p[i]) * np.linalg.norm(q[i])
        want = ((p[i] @ q[i] / n if n else 0.0) + 1) / 2
        assert got.get(i, 0.0) == pytest.approx(want, abs=1e-12)


def test_candidate_sets_are_compared_in_batches(monkeypatch):
    """rows of a query share its marks, whatever the order of rows and however few lines of marks fit."""
    from nearfield.operators import adaptive

    monkeypatch.setattr(adaptive, "MARKS", 25)
    sets = [[], [1], [1, 2, 3], [7, 9], [3, 7, 9, 11], [2, 3]]
    rows = [(q, p) for p in range(6) for q in (5, 0, 3, 4)]
    kind = pa.list_(pa.int32())
    common, union = adaptive._common(np.array([q for q, _ in rows]), pa.array([sets[p] for _, p in rows], kind), pa.array([sets[q] for q, _ in rows], kind))
    assert [(int(c), int(u)) for c, u in zip(common, union, strict=True)] == [(len({*sets[p]} & {*sets[q]}), len({*sets[p]} | {*sets[q]})) for q, p in rows]


def test_closest_pairs_look_at_few_tables(spark):
    """very close pairs need whole hashes of some tables only."""
    from nearfield.plans.index import AnnIndex

    index = AnnIndex(spark, "angular", 16, num_tables=40, hash_function="simhash").insert(_near(spark)).rebuild()
    found = [(r.id_a, r.id_b) for r in index.closest_pairs(5, 0.99).orderBy("rank").collect()]
    assert found == [(r.id_a, r.id_b) for r in index.closest_pairs_bf(5).orderBy("rank").collect()]
    rounds = index.query_metrics().collect()
    assert rounds[-1].depth == 24 and rounds[-1].finished == 1
