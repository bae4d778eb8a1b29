import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import exact
from nearfield.plans.index import AnnIndex
from nearfield.sources import points as sources
from nearfield.streaming import ingest


def frame(spark, rows, column="features", kind="array<double>"):
    return spark.createDataFrame([(i, list(v)) for i, v in rows], f"id long, {column} {kind}")


def asked(df):
    return df.withColumnRenamed("id", "query_id")


TINY = list(enumerate([(1.0, 0.0), (-1.0, -1.0), (1.0, 0.15), (1.0, 0.2), (1.0, -0.1)]))


@pytest.mark.parametrize("k", [0, 1, 2, 5, 10])
def test_exact_order(spark, k):
    found = exact.knn(frame(spark, TINY), asked(frame(spark, [(0, (1.0, 0.0))])), k).orderBy("rank").collect()
    assert [r.id for r in found] == [0, 4, 2, 3, 1][:k]


def test_exact_knn_matches_numpy_with_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-1, 2, size=(300, 4)).astype(float)
    found = exact.knn(frame(spark, enumerate(x.tolist())).repartition(5), asked(frame(spark, enumerate(x[:7].tolist()))), 12, "l2").orderBy("query_id", "rank").collect()
    for q in range(7):
        s = 1 / (1 + ((x - x[q]) ** 2).sum(1))
        want = sorted(range(300), key=lambda i: (-s[i], -i))[:12]
        assert [r.id for r in found if r.query_id == q] == want


def test_similarity_zero_is_no_result(spark):
    sets = frame(spark, [(0, [1, 2]), (1, [3]), (2, [])], "tokens", "array<int>")
    found = exact.knn(sets, asked(frame(spark, [(9, [1])], "tokens", "array<int>")), 3, "jaccard", "tokens").collect()
    assert [(r.id, r.similarity) for r in found] == [(0, 0.5)]


@pytest.mark.parametrize("block", [16, 1000])
def test_exact_pairs_with_many_copies(spark, block):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.tile([[1.0, 0, 0]], (60, 1)), rng.standard_normal((50, 3))])
    found = exact.closest_pairs(frame(spark, enumerate(x.tolist())), 7, "l2", block=block).orderBy("rank").collect()
    s = {(i, j): 1 / (1 + ((x[i] - x[j]) ** 2).sum()) for i in range(110) for j in range(i + 1, 110)}
    want = sorted(s, key=lambda p: (-s[p], -p[0], -p[1]))[:7]
    assert [(r.id_a, r.id_b) for r in found] == want


def test_empty_collection_and_nulls(spark):
    none = frame(spark, [])
    assert exact.knn(none, asked(frame(spark, TINY)), 3).count() == 0
    assert exact.knn(frame(spark, TINY), asked(none), 3).count() == 0
    assert exact.closest_pairs(none, 3).count() == 0
    some = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None)], "id long, features array<double>")
    assert [r.id for r in exact.knn(some, asked(frame(spark, [(0, (1.0, 0.0))])), 3).collect()] == [1]
    index = AnnIndex(spark, "angular", 2).rebuild()
    assert index.count() == 0 and index.closest_pairs(3, 0.8).count() == 0 and index.search(asked(frame(spark, TINY)), 3, 0.8).count() == 0


def recall_of(found, truth):
    have = {(r.query_id, r.id) for r in found}
    want = {(r.query_id, r.id) for r in truth}
    return len(have & want) / len(want)


@pytest.mark.parametrize(("options", "filter_type"), [({}, "default"), ({"hash_function": "simhash", "hash_source": "tensor"}, "none"), ({"hash_source": "pool", "source_args": {"pool_size": 400}}, "simple")])
def test_angular_recall(spark, options, filter_type):
    points = sources.random_vectors(spark, 600, 16, seed=3)
    index = AnnIndex(spark, "angular", 16, num_tables=16, **options).insert(points).rebuild()
    queries = asked(points.where("id < 25"))
    found = index.search(queries, 5, 0.8, filter_type).collect()
    assert len(found) == 125 and index.get_repetitions() == 16
    assert recall_of(found, index.search_bf(queries, 5).collect()) >= 0.8 * 0.8


def test_jaccard_recall_incremental_and_round_trip(spark, tmp_path):
    sets = sources.random_sets(spark, 400, 100)
    index = AnnIndex(spark, "jaccard", 100, num_tables=16).insert(sets.where("id < 200")).rebuild().insert(sets.where("id >= 200"))
    queries = asked(sets.where("id % 20 = 0"))
    first = index.search(queries, 4, 0.9, "none").collect()
    assert max(r.id for r in first) < 200  # not yet searchable
    assert index.search_bf(queries, 4).agg(F.max("id")).first()[0] >= 200
    index.rebuild()
    found = index.search(queries, 4, 0.9, "none").collect()
    assert recall_of(found, index.search_bf(queries, 4).collect()) >= 0.8 * 0.9
    index.save(str(tmp_path / "index"))
    loaded = AnnIndex.load(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, loaded.search(queries, 4, 0.9, "none").collect())) == sorted(map(tuple, found))


def test_search_from_index_leaves_out_the_point_itself(spark):
    points = sources.random_vectors(spark, 150, 8, seed=4).unionByName(frame(spark, [(150, [1.0] * 8), (151, [1.0] * 8)]).select("id", F.col("features").cast("array<float>")))
    index = AnnIndex(spark, "angular", 8, num_tables=8).insert(points).rebuild()
    found = index.search_from_index(spark.createDataFrame([(150,)], "id long"), 3, 0.9).orderBy("rank").collect()
    assert found[0].id == 151 and 150 not in {r.id for r in found}


def test_closest_pairs(spark):
    points = sources.random_vectors(spark, 200, 8, seed=6)
    index = AnnIndex(spark, "angular", 8, num_tables=16).insert(points).rebuild()
    found = {(r.id_a, r.id_b) for r in index.closest_pairs(8, 0.9).collect()}
    assert len(found & {(r.id_a, r.id_b) for r in index.closest_pairs_bf(8).collect()}) >= 6


def near_points(spark, n, dimensions, seed):
    """n points, and each again with noise, ids n higher."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dimensions))
    y = x + 0.15 * rng.standard_normal((n, dimensions))
    return frame(spark, enumerate(np.concatenate([x, y]).tolist()))


@pytest.mark.parametrize(("filter_type", "options"), [("default", {}), ("simple", {"hash_function": "simhash"}), ("none", {"hash_function": "simhash", "hash_source": "tensor", "num_tables": 100}), ("default", {"storage": "q15", "hash_function": "crosspolytope"})])
def test_tables_answer_without_brute_force(spark, monkeypatch, filter_type, options):
    index = AnnIndex(spark, "angular", 24, **({"num_tables": 48} | options)).insert(near_points(spark, 500, 24, 1)).rebuild()
    queries = asked(near_points(spark, 500, 24, 1).where("id < 30"))
    truth = index.search_bf(queries, 2).collect()
    monkeypatch.setattr(exact, "knn", None)  # any call fails
    found = index.search(queries, 2, 0.95, filter_type).collect()
    assert recall_of(found, truth) >= 0.95
    rounds = index.query_metrics().collect()
    assert sum(r.finished for r in rounds) == 30 and all(r.depth > 0 for r in rounds)


@pytest.mark.parametrize("family", ["simhash", "fht_crosspolytope"])
def test_tables_find_the_closest_pairs(spark, monkeypatch, family):
    index = AnnIndex(spark, "angular", 24, num_tables=48, hash_function=family).insert(near_points(spark, 500, 24, 1)).rebuild()
    want = {(r.id_a, r.id_b) for r in index.closest_pairs_bf(10).collect()}
    monkeypatch.setattr(exact, "closest_pairs", None)  # any call fails
    assert {(r.id_a, r.id_b) for r in index.closest_pairs(10, 0.999).collect()} == want
    assert all(r.depth > 0 for r in index.query_metrics().collect())


def test_hashes_that_say_nothing_answer_nothing(spark, monkeypatch):
    """With scrambled hashes the tables finish few queries, so the counts above come from the families."""
    from nearfield.operators import tables

    points = near_points(spark, 500, 24, 1)
    hashed = tables.hashed

    def scrambled(*a, **b):
        noise = F.transform("hashes", lambda h, t: F.pmod(F.xxhash64(F.col("id"), t), F.lit(1 << 24)).cast("int"))
        return hashed(*a, **b).withColumn("hashes", noise)

    monkeypatch.setattr(tables, "hashed", scrambled)
    index = AnnIndex(spark, "angular", 24, num_tables=8).insert(points).rebuild()
    index.search(asked(points.where("id < 30")), 2, 0.95, "none").collect()
    assert sum(r.finished for r in index.query_metrics().collect() if r.depth > 0) < 15


def test_segments_are_compacted_and_answers_stay(spark, monkeypatch):
    from nearfield.plans import index as plans

    monkeypatch.setattr(plans, "SEGMENTS", 3)
    points = near_points(spark, 150, 8, 2)
    index, whole = AnnIndex(spark, "angular", 8, num_tables=8), AnnIndex(spark, "angular", 8, num_tables=8).insert(points).rebuild()
    for part in range(4):
        index.insert(points.where(f"id % 4 = {part}")).rebuild()
    assert len(index.segments) == 2 and index.built_count == 300
    rows = lambda i: sorted(map(tuple, i.tables.collect()))
    assert rows(index) == rows(whole) and sorted(map(tuple, index.directory().collect())) == sorted(map(tuple, whole.directory().collect()))


def test_memory_sets_the_tables_without_a_cap(spark):
    index = AnnIndex(spark, "angular", 2, memory_limit=20_000_000, hash_function="simhash").insert(frame(spark, TINY)).rebuild()
    assert index.get_repetitions() > 128
    assert index.clear().get_repetitions() == 0 and index.count() == 0


def test_vectors_of_other_lengths_are_errors(spark):
    odd = frame(spark, [(0, (1.0, 0.0)), (1, (1.0,))])
    for bad in (lambda: exact.closest_pairs(odd, 2), lambda: exact.knn(odd, asked(frame(spark, TINY)), 1).collect(), lambda: exact.knn(frame(spark, TINY), asked(odd), 1)):
        with pytest.raises(Exception, match="one length"):
            bad()
    hollow = spark.createDataFrame([(0, [1, None, 2]), (1, [2, 1])], "id long, tokens array<int>")
    assert [r.similarity for r in exact.knn(hollow, asked(hollow.where("id = 0")), 2, "jaccard", "tokens").collect()] == [1.0, 1.0]


def test_pickled_index_answers_as_before(spark):
    import pickle

    points = near_points(spark, 100, 8, 3)
    index = AnnIndex(spark, "angular", 8, num_tables=8).insert(points).rebuild().insert(frame(spark, [(900, [1.0] * 8)]))
    again = pickle.loads(pickle.dumps(index))
    queries = asked(points.where("id < 5"))
    rows = lambda i: sorted(map(tuple, i.search(queries, 3, 0.8, "none").collect()))
    assert rows(again) == rows(index) and again.count() == 201 and again.get_repetitions() == 8


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from nearfield import session

    none = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: none, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(SimpleNamespace(sparkContext=context, conf=none))


def test_l2_collections_are_searched_exactly(spark, tmp_path):
    index = AnnIndex(spark, "l2", 2).insert(frame(spark, TINY)).rebuild()
    assert [r.id for r in index.search_bf(asked(frame(spark, [(0, (1.0, 0.0))])), 3).orderBy("rank").collect()] == [0, 4, 2]
    with pytest.raises(ValueError, match="l2"):
        index.search(asked(frame(spark, TINY)), 1, 0.5)
    index.save(str(tmp_path / "l2"))
    assert AnnIndex.load(spark, str(tmp_path / "l2")).count() == 5


def test_errors(spark):
    with pytest.raises(ValueError):
        AnnIndex(spark, "angular", 3, sketch_function="crosspolytope")
    with pytest.raises(ValueError):
        AnnIndex(spark, "jaccard", 3, storage="q15")
    with pytest.raises(ValueError):
        AnnIndex(spark, "euclid", 3)
    with pytest.raises(ValueError):
        AnnIndex(spark, "angular", 3, hash_function="minhash")
    index = AnnIndex(spark, "angular", 2, memory_limit=10).insert(frame(spark, TINY))
    with pytest.raises(ValueError, match="insufficient"):
        index.rebuild()
    with pytest.raises(ValueError):
        index.search(asked(frame(spark, TINY)), 1, 0.5, "other")


def test_word_vectors(spark, tmp_path):
    (tmp_path / "v.txt").write_text("the 0.5 -1\n\nof 2 3\n")
    found = sources.read_word_vectors(spark, str(tmp_path / "v.txt")).collect()
    assert {r.word: r.features for r in found} == {"the": [0.5, -1.0], "of": [2.0, 3.0]}


def test_streamed_inserts_and_queries(spark, tmp_path):
    points = sources.random_vectors(spark, 120, 4, seed=8)
    points.write.parquet(str(tmp_path / "points"))
    index = AnnIndex(spark, "angular", 4, num_tables=4)
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "points"))
    ingest.insert_stream(index, stream, str(tmp_path / "c1")).awaitTermination()
    assert index.count() == 120 and index.get_repetitions() == 4
    asked(points.where("id < 3")).write.parquet(str(tmp_path / "asked"))
    questions = spark.readStream.schema("query_id long, features array<float>").parquet(str(tmp_path / "asked"))
    ingest.answer_stream(index, questions, 2, 0.9, str(tmp_path / "answers"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "answers")).count() == 6


def test_null_rows_are_left_out_and_equal_ids_keep_their_points(spark):
    rows = [(i, [1.0, float(i)]) for i in range(150)] + [(None, [1.0, 0.0]), (7, None), (7, [0.0, 1.0])]
    points = spark.createDataFrame(rows, "id long, features array<double>")
    index = AnnIndex(spark, "angular", 2, num_tables=16, hash_function="simhash").insert(points).rebuild()
    assert index.count() == index.built_count == 151
    questions = spark.createDataFrame([(1, [0.0, 2.0]), (1, [0.0, 2.0]), (2, None)], "query_id long, features array<double>")
    found = index.search(questions, 1, 0.9999, "none").collect()
    assert [(r.query_id, r.id, round(r.similarity, 9)) for r in found] == [(1, 7, 1.0)]
    sketches = index.built.where("id = 7").select("features", "sketches").collect()
    assert len(sketches) == 2 and sketches[0].sketches != sketches[1].sketches


def test_normalise_of_nulls_and_zero(spark):
    from nearfield.functions import formats

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<double>")
    assert [r[0] for r in df.select(formats.normalise(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0], None, []]
