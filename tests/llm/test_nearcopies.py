"""Near-duplicates by five-word shingles against all pairs."""

import random

import numpy as np
import pytest

from nearfield.llm import nearcopies as N

WORDS = [f"w{k}" for k in range(4_000)]


def jaccard(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def roots(sets):
    """For each set the first of its component, by comparing all pairs."""
    n = len(sets)
    near = [[j for j in range(n) if jaccard(sets[i], sets[j]) >= N.SIMILARITY] for i in range(n)]
    first = [-1] * n
    for i in range(n):
        stack = [i] if first[i] < 0 else []
        while stack:
            x = stack.pop()
            if first[x] < 0:
                first[x] = i
                stack += [y for y in near[x] if first[y] < 0]
    return first


def changed(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


@pytest.mark.parametrize("seed", range(6))
def test_components_of_sets(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 60, 40) for _ in range(4)]
    sets = [np.unique(np.where(rng.random(40) < 0.06, rng.integers(0, 60, 40), base[k % 4])).astype(np.int64) for k in range(60)] + [np.zeros(0, np.int64)] * 3
    assert N.connected(sets).tolist() == roots(sets)


@pytest.mark.parametrize("part", [4_000, 3])
def test_documents_against_all_pairs(part, spark, monkeypatch):
    monkeypatch.setattr(N, "PART_TEXTS", part)
    rng = random.Random(4)
    texts = []
    for _ in range(25):
        words = [rng.choice(WORDS) for _ in range(rng.choice([30, 120, 400]))]
        texts += [" ".join(changed(rng, words, rng.choice([0, 1, max(1, len(words) // 60)]))) for _ in range(rng.choice([1, 1, 4, 9]))]
    texts += [None, "", " \t", "one", "ONE", "one two", "one  two"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.component_id for r in N.near_duplicates(docs).collect()}
    first = roots([N.shingles(t.encode() if t else None) for t in texts])
    want = {i: min(ids[k] for k in range(len(texts)) if first[k] == first[j]) for j, i in enumerate(ids)}
    pairs = lambda c: {(a, b) for a in c for b in c if a < b and c[a] == c[b]}
    assert pairs(found) <= pairs(want)  # no link is false
    assert len(pairs(found)) >= 0.97 * len(pairs(want))
    kept = [r.doc_id for r in N.keep_first(docs).collect()]
    assert sorted(kept) == sorted(set(found.values()))


def test_recall_on_the_documents(spark):
    """Of all pairs of Jaccard 0.8 and more between different texts of a table, nine of ten are in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets = {r.doc_id: N.shingles(r.text.encode() if r.text else None) for r in rows}
    where = {}
    for i, s in sets.items():
        for h in s.tolist():
            where.setdefault(h, []).append(i)
    shared = {(a, b) for of in where.values() if len(of) < 100 for a in of for b in of if a < b}
    near = [(a, b) for a, b in shared if not np.array_equal(sets[a], sets[b]) and jaccard(sets[a], sets[b]) >= N.SIMILARITY]
    found = {r.doc_id: r.component_id for r in N.near_duplicates(docs).collect()}
    assert near and sum(found[a] == found[b] for a, b in near) >= 0.9 * len(near)


def test_odd_rows(spark):
    schema = "doc_id long, text string, class string, digest string, number int"
    rows = [(None, "a b c d e f", "x", "y", 1), (None, "a b c d e f", "x", "y", 1), (3, "A b c d e f", "x", "y", 1), (None, None, "x", "y", 1), (None, "", "x", "y", 1), (5, "q", "x", "y", 1), (5, "q", "x", "y", 1), (5, "r", "x", "y", 1)]
    docs = spark.createDataFrame(rows, schema)
    kept = N.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (3, "A b c d e f"), (5, "q"), (5, "r")]
    assert N.keep_first(spark.createDataFrame([], schema)).count() == 0
