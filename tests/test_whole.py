"""Queries over the whole query set and whole vectors ask all that they name."""

import pytest

from nearfield.plans import catalog, searches  # noqa: F401  searches registers its queries


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """90 vectors of 64 dimensions, some with large ids."""
    path = tmp_path_factory.mktemp("few")
    rows = [(i if i < 80 else i * 20, [float((i * 7 + d * d * (i % 5 + 1)) % 23 - 11) / 64 for d in range(64)], 0) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path), sorted(r[0] for r in rows)


@pytest.mark.parametrize("name", ["knn_cosine_bf", "knn_l2_bf", "knn_from_index_bf", "prefix_candidates", "sketch_hamming_filter"])
def test_every_20th_point_is_asked(name, spark, few):
    path, ids = few
    asked = {r.query_id for r in catalog.QUERIES[name](spark, path).select("query_id").distinct().collect()}
    assert asked == {i for i in ids if i % 20 == 0} and len(asked) == 14


def test_metrics_count_the_table(spark, sf_dir):
    asked = catalog.asked_vectors(spark, sf_dir, catalog.EVERY_20TH).count()
    found = catalog.QUERIES["search_metrics"](spark, sf_dir).first()
    assert asked > 20 and (found.queries, found.finished) == (asked, asked)


def test_merged_lists_hold_every_point(spark, few):
    path, _ = few
    pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
    points = catalog.vectors(spark, path)
    found = pairs(catalog.QUERIES["topk_merge_dedup"](spark, path))
    assert found == pairs(catalog.exact.knn(points, catalog.asked_vectors(spark, path, catalog.EVERY_20TH), catalog.K))
    assert any(i % 6 == 3 for _, i in found)


def test_whole_vectors_are_transformed_and_read(spark, few):
    path, ids = few
    rows = catalog.QUERIES["hadamard_transform"](spark, path).collect()
    assert len(rows) == 64 * len(ids)
    first = {r.id: sum(int(x * 32768) for x in r.features) for r in catalog.vectors(spark, path).collect()}
    assert {r.id: r.total for r in rows if r.axis == 0} == first
    assert {r.id for r in catalog.QUERIES["get_points"](spark, path).collect()} == {i for i in ids if i % 20 == 0}
