"""Registered queries of the similarity engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import formats, probability, similarity
from nearfield.operators import exact, families, hash_sources, relational, tables
from nearfield.plans.index import AnnIndex
from nearfield.session import scratch_path
from nearfield.sources import points as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIMENSIONS = 64
UNIVERSE = 4096
#: The query set of searches: stored points, as many as the table's size asks for.
EVERY_20TH = "id % 20 = 0"
K = 10


def query(sql: str | None = None, name: str | None = None):
    """Register a query, with its SQL where there is one."""

    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.table_points(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "embedding")


def asked_vectors(spark: SparkSession, sf_dir: str, asked: str = EVERY_20TH) -> DataFrame:
    return vectors(spark, sf_dir).where(asked).withColumnRenamed("id", "query_id")


def doc_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = sources.table_points(spark, f"{sf_dir}/documents.parquet", "doc_id", "text", "text")
    return formats.text_sets(texts.select("id", "text"), UNIVERSE)


def bench_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.text_sets(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text"), UNIVERSE)


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct parts of each order."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("int"))).alias("tokens"))


def rounded(df: DataFrame, column: str = "similarity") -> DataFrame:
    return df.withColumn(column, F.round(column, 6))


# SQL pieces

DOC_SETS = f"""
d AS (SELECT doc_id AS id, list_sort(list_distinct(list_transform(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> ''),
    lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % {UNIVERSE})::INT))) AS tokens FROM documents)"""
BENCH_SETS = DOC_SETS.replace("d AS (SELECT doc_id AS id", "b AS (SELECT item_id AS id").replace("FROM documents", "FROM benchmark")
JACCARD = "CASE WHEN len(list_distinct(list_concat(a.tokens, c.tokens))) = 0 THEN 0.0 ELSE len(list_intersect(a.tokens, c.tokens))::DOUBLE / len(list_distinct(list_concat(a.tokens, c.tokens))) END"


def knn_sql(similar: str, where: str = "", exclude_self: bool = False, asked: str = "% 20 = 0") -> str:
    return f"""
WITH s AS (SELECT q.vec_id AS query_id, p.vec_id AS id, {similar} AS s FROM embeddings q, embeddings p
    WHERE q.vec_id {asked} {"AND q.vec_id <> p.vec_id" if exclude_self else ""} {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id DESC) AS rank FROM s WHERE s > 0)
SELECT query_id, id, round(s, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= {K}"""


COSINE = "(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) + 1) / 2"
L2 = "1 / (1 + list_distance(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) ** 2)"
PAIRS_SQL = f"""
SELECT id_a, id_b, round(s, 6) AS similarity, row_number() OVER (ORDER BY s DESC, id_a DESC, id_b DESC)::INT AS rank
FROM (SELECT q.vec_id AS id_a, p.vec_id AS id_b, {{}} AS s FROM embeddings q JOIN embeddings p ON q.vec_id < p.vec_id)
ORDER BY s DESC, id_a DESC, id_b DESC LIMIT {K}"""

# formats


@query("SELECT vec_id AS id, dim - 1 AS dim, round(coalesce(3 * embedding[dim]::DOUBLE / nullif(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: 9 * x * x))), 0), 0), 6) AS value FROM embeddings, generate_series(1, 64) g(dim)")
def normalize_vectors(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", F.transform("features", lambda x: x * 3).alias("features"))
    return v.select("id", F.posexplode(formats.normalise(F.col("features"))).alias("dim", "value")).select("id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query("SELECT vec_id AS id, dim - 1 AS dim, least(trunc(embedding[dim]::DOUBLE * 32768), 32767)::SMALLINT AS code FROM embeddings, generate_series(1, 64) g(dim)")
def quantize_q15(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.posexplode(formats.quantise(F.col("features"))).alias("dim", "code")).select("id", F.col("dim").cast("long").alias("dim"), "code")


@query("SELECT vec_id AS id, dim - 1 AS dim, least(trunc(embedding[dim]::DOUBLE * 32768), 32767) / 32768 AS value FROM embeddings, generate_series(1, 64) g(dim) WHERE vec_id % 20 = 0")
def get_points(spark, sf_dir):
    """Stored points by id, read back from 16-bit codes."""
    v = vectors(spark, sf_dir).where(EVERY_20TH).select("id", formats.dequantise(formats.quantise(F.col("features"))).alias("v"))
    return v.select("id", F.posexplode("v").alias("dim", "value")).select("id", F.col("dim").cast("long").alias("dim"), "value")


@query(f"WITH {DOC_SETS} SELECT id, len(tokens)::BIGINT AS n, coalesce(list_min(tokens), -1) AS least, coalesce(list_max(tokens), -1) AS largest, coalesce(list_sum(tokens), 0)::BIGINT AS total FROM d")
def token_sets(spark, sf_dir):
    t = F.col("tokens")
    return doc_sets(spark, sf_dir).select("id", F.size(t).cast("long").alias("n"), F.coalesce(F.array_min(t), F.lit(-1)).alias("least"), F.coalesce(F.array_max(t), F.lit(-1)).alias("largest"), F.aggregate(t, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT count(*)::BIGINT AS points FROM embeddings")
def cardinality(spark, sf_dir):
    return vectors(spark, sf_dir).agg(F.count("*").alias("points"))


@query("SELECT (d)::INT AS dimensions, (ceil(d / 16.0) * 16)::INT AS padded FROM generate_series(0, 64) g(d)")
def pad_dimensions(spark, sf_dir):
    return spark.createDataFrame([(d, formats.padded_dimensions(d)) for d in range(65)], "dimensions int, padded int")


# similarities


@query(f"SELECT q.vec_id AS id_a, p.vec_id AS id_b, round({COSINE}, 6) AS similarity FROM embeddings q JOIN embeddings p ON p.vec_id = q.vec_id + 1")
def cosine_pairs(spark, sf_dir):
    a, b = vectors(spark, sf_dir).toDF("id_a", "a"), vectors(spark, sf_dir).toDF("id_b", "b")
    return a.join(b, F.col("id_b") == F.col("id_a") + 1).select("id_a", "id_b", F.round(similarity.cosine01(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"SELECT q.vec_id AS id_a, p.vec_id AS id_b, round({L2}, 6) AS similarity FROM embeddings q JOIN embeddings p ON p.vec_id = q.vec_id + 1")
def l2_similarity_pairs(spark, sf_dir):
    a, b = vectors(spark, sf_dir).toDF("id_a", "a"), vectors(spark, sf_dir).toDF("id_b", "b")
    return a.join(b, F.col("id_b") == F.col("id_a") + 1).select("id_a", "id_b", F.round(similarity.l2_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(
    "SELECT q.vec_id AS id_a, p.vec_id AS id_b, list_sum(list_transform(range(1, 65), lambda i: trunc(q.embedding[i]::DOUBLE * 32768)::BIGINT * trunc(p.embedding[i]::DOUBLE * 32768)::BIGINT))::BIGINT AS dot FROM embeddings q JOIN embeddings p ON p.vec_id = q.vec_id + 1"
)
def q15_dot_products(spark, sf_dir):
    """Integer dot products of 16-bit codes, in 64 bits so that they cannot overflow."""
    a, b = vectors(spark, sf_dir).toDF("id_a", "a"), vectors(spark, sf_dir).toDF("id_b", "b")
    total = F.aggregate(F.zip_with(formats.quantise(F.col("a")), formats.quantise(F.col("b")), lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)
    return a.join(b, F.col("id_b") == F.col("id_a") + 1).select("id_a", "id_b", total.alias("dot"))


@query(f"WITH {DOC_SETS} SELECT a.id AS id_a, c.id AS id_b, round({JACCARD}, 6) AS similarity FROM d a JOIN d c ON c.id = a.id + 1")
def jaccard_pairs(spark, sf_dir):
    a, b = doc_sets(spark, sf_dir).toDF("id_a", "a"), doc_sets(spark, sf_dir).toDF("id_b", "b")
    return a.join(b, F.col("id_b") == F.col("id_a") + 1).select("id_a", "id_b", F.round(similarity.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


# exact search


@query(knn_sql(COSINE, exclude_self=True))
def knn_cosine_bf(spark, sf_dir):
    return rounded(exact.knn(vectors(spark, sf_dir), asked_vectors(spark, sf_dir), K, exclude_self=True))


@query(knn_sql(L2))
def knn_l2_bf(spark, sf_dir):
    return rounded(exact.knn(vectors(spark, sf_dir), asked_vectors(spark, sf_dir), K, "l2"))


@query(
    f"""WITH {DOC_SETS}, {BENCH_SETS},
s AS (SELECT a.id AS query_id, c.id AS id, {JACCARD} AS s FROM b a, d c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id DESC) AS rank FROM s WHERE s > 0)
SELECT query_id, id, round(s, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= {K}"""
)
def knn_jaccard_bf(spark, sf_dir):
    return rounded(exact.knn(doc_sets(spark, sf_dir), bench_sets(spark, sf_dir), K, "jaccard", "tokens"))


@query(knn_sql(COSINE, exclude_self=True))
def knn_from_index_bf(spark, sf_dir):
    """Neighbours of stored points by id, at full recall."""
    index = AnnIndex(spark, "angular", DIMENSIONS, num_tables=2).insert(vectors(spark, sf_dir)).rebuild()
    return rounded(index.search_from_index(vectors(spark, sf_dir).where(EVERY_20TH).select("id"), K, 1.0))


@query(PAIRS_SQL.format(COSINE))
def closest_pairs_cosine_bf(spark, sf_dir):
    return rounded(exact.closest_pairs(vectors(spark, sf_dir), K))


@query(PAIRS_SQL.format(L2))
def closest_pairs_l2_bf(spark, sf_dir):
    return rounded(exact.closest_pairs(vectors(spark, sf_dir), K, "l2"))


@query(
    f"""WITH {DOC_SETS} SELECT id_a, id_b, round(s, 6) AS similarity, row_number() OVER (ORDER BY s DESC, id_a DESC, id_b DESC)::INT AS rank
FROM (SELECT a.id AS id_a, c.id AS id_b, {JACCARD} AS s FROM d a JOIN d c ON a.id < c.id) WHERE s > 0 ORDER BY s DESC, id_a DESC, id_b DESC LIMIT {K}"""
)
def closest_pairs_jaccard_bf(spark, sf_dir):
    return rounded(exact.closest_pairs(doc_sets(spark, sf_dir), K, "jaccard", "tokens"))


@query(
    f"""WITH d AS (SELECT l_orderkey AS id, list(DISTINCT l_partkey) AS tokens FROM lineitem GROUP BY 1), e AS (SELECT id, unnest(tokens) AS t, len(tokens) AS n FROM d),
p AS (SELECT a.id AS id_a, c.id AS id_b, count(*)::DOUBLE / (a.n + c.n - count(*)) AS s FROM e a JOIN e c ON a.t = c.t AND a.id < c.id GROUP BY a.id, c.id, a.n, c.n)
SELECT id_a, id_b, round(s, 6) AS similarity, row_number() OVER (ORDER BY s DESC, id_a DESC, id_b DESC)::INT AS rank FROM p ORDER BY s DESC, id_a DESC, id_b DESC LIMIT {K}"""
)
def closest_baskets_bf(spark, sf_dir):
    return rounded(exact.closest_pairs(baskets(spark, sf_dir), K, "jaccard", "tokens"))


@query(knn_sql(COSINE))
def topk_merge_dedup(spark, sf_dir):
    """The k best of two overlapping candidate lists that hold every point between them, each candidate once."""
    v, q = vectors(spark, sf_dir), asked_vectors(spark, sf_dir)
    parts = [exact.knn(v.where(w), q, K).drop("rank") for w in ("id % 3 <> 0", "id % 3 <> 1")]
    merged = parts[0].unionByName(parts[1]).dropDuplicates(["query_id", "id"])
    return rounded(exact.top_k(merged, K))


# hash families as relations

TABLES, BITS = 4, 12
PLANES_SQL = f"""
planes AS (SELECT t AS table_id, b AS bit, m AS dim, 1 - 2 * (('0x' || substr(md5('42:' || t || ':' || b || ':' || m), 1, 8))::BIGINT % 2) AS sign
    FROM generate_series(0, {TABLES - 1}) x(t), generate_series(0, {BITS - 1}) y(b), generate_series(0, {DIMENSIONS - 1}) z(m)),
coords AS (SELECT vec_id AS id, g.m AS dim, least(trunc(embedding[g.m + 1]::DOUBLE * 32768), 32767)::BIGINT AS code FROM embeddings, generate_series(0, {DIMENSIONS - 1}) g(m)),
sums AS (SELECT table_id, id, bit, sum(code * sign) AS total FROM coords JOIN planes USING (dim) GROUP BY ALL),
h AS (SELECT table_id::INT AS table_id, id, sum(CASE WHEN total >= 0 THEN 1 << ({BITS} - 1 - bit::INT) ELSE 0 END)::INT AS hash FROM sums GROUP BY ALL)"""


def hash_rows(spark, sf_dir) -> DataFrame:
    return relational.simhash_tables(vectors(spark, sf_dir), TABLES, BITS, DIMENSIONS)


@query(f"WITH {PLANES_SQL} SELECT * FROM h")
def simhash_tables(spark, sf_dir):
    return hash_rows(spark, sf_dir)


MINHASH_SQL = f"""{DOC_SETS}, e AS (SELECT id, unnest(tokens) AS token FROM d),
m AS (SELECT t::INT AS table_id, id, token, ('0x' || substr(md5('42:' || t || ':' || token), 1, 8))::BIGINT AS hash FROM e, generate_series(0, 3) g(t)),
w AS (SELECT *, row_number() OVER (PARTITION BY table_id, id ORDER BY hash, token) AS k FROM m)"""


@query(f"WITH {MINHASH_SQL} SELECT table_id, id, token, hash FROM w WHERE k = 1")
def minhash_tables(spark, sf_dir):
    return relational.minhash_tables(doc_sets(spark, sf_dir), 4)


@query(f"WITH {MINHASH_SQL} SELECT table_id, id, (token % 2)::INT AS bit FROM w WHERE k = 1")
def minhash_1bit(spark, sf_dir):
    return relational.minhash_tables(doc_sets(spark, sf_dir), 4).select("table_id", "id", (F.col("token") % 2).alias("bit"))


@query(
    "WITH t AS (SELECT k::INT AS token FROM generate_series(0, 4999) g(k)) SELECT token, xor(xor(('0x' || substr(md5('42:0:' || (token & 255)), 1, 8))::BIGINT, ('0x' || substr(md5('42:1:' || ((token >> 8) & 255)), 1, 8))::BIGINT), xor(('0x' || substr(md5('42:2:' || ((token >> 16) & 255)), 1, 8))::BIGINT, ('0x' || substr(md5('42:3:' || ((token >> 24) & 255)), 1, 8))::BIGINT)) AS hash FROM t"
)
def tabulation_hashes(spark, sf_dir):
    return spark.range(5000).select(F.col("id").cast("int").alias("token"), relational.tabulation_hash(F.col("id")).alias("hash"))


@query(
    f"""WITH {PLANES_SQL.split("planes AS")[0]} c AS (SELECT vec_id AS id, g.m AS dim, least(trunc(embedding[g.m + 1]::DOUBLE * 32768), 32767)::BIGINT * (1 - 2 * (('0x' || substr(md5('42:0:0:' || g.m), 1, 8))::BIGINT % 2)) AS code
    FROM embeddings, generate_series(0, {DIMENSIONS - 1}) g(m)),
t AS (SELECT id, a AS axis, sum(code * (1 - 2 * (bit_count((dim & a)::BIGINT) % 2)))::BIGINT AS total FROM c, generate_series(0, {DIMENSIONS - 1}) x(a) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(total) DESC, axis) AS k FROM t)
SELECT id, (axis + CASE WHEN total < 0 THEN {DIMENSIONS} ELSE 0 END)::INT AS hash FROM r WHERE k = 1"""
)
def cross_polytope_hashes(spark, sf_dir):
    """One rotation of sign flips and a Hadamard transform, then the closest signed axis."""
    signs = F.broadcast(relational.sign_planes(spark, 1, 1, DIMENSIONS).select("dim", "sign"))
    flipped = relational.coordinates(vectors(spark, sf_dir), "id", "features").join(signs, "dim").select("id", "dim", (F.col("code") * F.col("sign")).alias("code"))
    return relational.closest_axes(relational.hadamard_rows(flipped, DIMENSIONS), DIMENSIONS).select("id", F.col("hash").cast("int").alias("hash"))


@query(
    f"WITH c AS (SELECT vec_id AS id, g.m AS dim, least(trunc(embedding[g.m + 1]::DOUBLE * 32768), 32767)::BIGINT AS code FROM embeddings, generate_series(0, {DIMENSIONS - 1}) g(m)) SELECT id, a::INT AS axis, sum(code * (1 - 2 * (bit_count((dim & a)::BIGINT) % 2)))::BIGINT AS total FROM c, generate_series(0, {DIMENSIONS - 1}) x(a) GROUP BY ALL"
)
def hadamard_transform(spark, sf_dir):
    """The transform of all coordinates."""
    return relational.hadamard_rows(relational.coordinates(vectors(spark, sf_dir), "id", "features"), DIMENSIONS)


# tables and filters

DEPTH_SHIFT = BITS - 6


@query(f"WITH {PLANES_SQL} SELECT table_id, hash >> {DEPTH_SHIFT} AS prefix, count(*)::BIGINT AS size FROM h GROUP BY ALL")
def prefix_buckets(spark, sf_dir):
    rows = hash_rows(spark, sf_dir).withColumn("hash", F.shiftleft("hash", hash_sources.DEPTH - BITS))
    return tables.bucket_sizes(rows, 6)


@query(f"WITH {PLANES_SQL} SELECT DISTINCT q.id AS query_id, p.id FROM h q JOIN h p ON q.table_id = p.table_id AND q.hash >> {DEPTH_SHIFT} = p.hash >> {DEPTH_SHIFT} WHERE q.id % 20 = 0")
def prefix_candidates(spark, sf_dir):
    rows = hash_rows(spark, sf_dir).withColumn("hash", F.shiftleft("hash", hash_sources.DEPTH - BITS))
    queries = rows.where(EVERY_20TH).withColumnRenamed("id", "query_id")
    return tables.prefix_candidates(queries, rows, 6).select("query_id", "id").distinct()


@query(f"WITH {PLANES_SQL} SELECT table_id, hash, count(*)::BIGINT AS points, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM h GROUP BY ALL HAVING count(*) > 1")
def equal_hash_segments(spark, sf_dir):
    """Segments of equal hashes and the pairs that each stands for, without making the pairs."""
    n = F.count("*")
    return hash_rows(spark, sf_dir).groupBy("table_id", "hash").agg(n.alias("points")).where("points > 1").select("table_id", "hash", "points", F.expr("points * (points - 1) div 2").alias("pairs"))


@query(f"WITH {PLANES_SQL} SELECT q.table_id, q.id AS query_id, p.id FROM h q JOIN h p ON q.table_id = p.table_id WHERE q.id % 20 = 0 AND bit_count(xor(q.hash, p.hash)) <= 2")
def sketch_hamming_filter(spark, sf_dir):
    rows = hash_rows(spark, sf_dir)
    queries = F.broadcast(rows.where(EVERY_20TH).select("table_id", F.col("id").alias("query_id"), F.col("hash").alias("asked")))
    return rows.join(queries, "table_id").where(tables.sketch_passes(F.col("hash"), F.col("asked"), F.lit(2))).select("table_id", "query_id", "id")


# probabilities


def grid(spark: SparkSession) -> DataFrame:
    return spark.range(101).select((F.col("id") / 100).alias("s"))


GRID = "grid AS (SELECT i / 100 AS s FROM generate_series(0, 100) g(i))"
P1 = "(1 - acos(2 * s - 1) / pi())"


@query(f"WITH {GRID} SELECT s, round({P1}, 9) AS p FROM grid")
def collision_prob_simhash(spark, sf_dir):
    return grid(spark).select("s", F.round(probability.simhash_column(1, F.col("s")), 9).alias("p"))


@query(f"WITH {GRID} SELECT s, b::INT AS bits, round(s + (1 - s) * ((100 / least(2 ** b, 100) - 1) / 99), 9) AS p FROM grid, generate_series(0, 7) h(b)")
def collision_prob_minhash(spark, sf_dir):
    p = probability.minhash_column(100)
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.round(p(b, F.col("s")), 9).alias("p")) for b in range(8)])).alias("x")
    return grid(spark).select("s", each).select("s", "x.bits", "x.p")


@query(f"WITH {GRID} SELECT s, d::INT AS depth, round((1 - {P1} ** d) ** 64, 9) AS failure FROM grid, generate_series(1, 24) h(d)")
def failure_prob_independent(spark, sf_dir):
    c = probability.concatenated_column(probability.simhash_column, 1)
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.round(probability.independent_failure_column(c, d, 64, F.col("s")), 9).alias("failure")) for d in range(1, 25)])).alias("x")
    return grid(spark).select("s", each).select("s", "x.depth", "x.failure")


@query(f"WITH {GRID} SELECT s, d::INT AS depth, round(1 - (1 - (1 - {P1} ** ((d + 1) // 2)) ** 8) * (1 - (1 - {P1} ** (d - (d + 1) // 2)) ** 8), 9) AS failure FROM grid, generate_series(1, 24) h(d)")
def failure_prob_tensor(spark, sf_dir):
    c = probability.concatenated_column(probability.simhash_column, 1)
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.round(probability.tensor_failure_column(c, d, 64, F.col("s")), 9).alias("failure")) for d in range(1, 25)])).alias("x")
    return grid(spark).select("s", each).select("s", "x.depth", "x.failure")


@query(f"WITH {GRID} SELECT s, round(64 * (1 - {P1}))::INT AS threshold FROM grid")
def sketch_threshold(spark, sf_dir):
    return grid(spark).select("s", probability.sketch_threshold_column(probability.simhash_column, F.col("s")).alias("threshold"))


@query("SELECT i::INT AS i, (CASE WHEN k < r THEN k ELSE r END)::INT AS a, (CASE WHEN k < r THEN r ELSE k - r END)::INT AS b FROM (SELECT i, floor(sqrt(i))::BIGINT AS r, i - floor(sqrt(i))::BIGINT ** 2 AS k FROM generate_series(0, 99) g(i))")
def tensor_index_pairs(spark, sf_dir):
    return spark.createDataFrame([(i, *hash_sources.grid_pair(i)) for i in range(100)], "i int, a int, b int")


@query("SELECT x::BIGINT AS x, list_sum(list_transform(range(0, 12), lambda k: ((x::BIGINT >> k) & 1) << (2 * k)))::BIGINT AS spread FROM generate_series(0, 4095) g(x)")
def interleaved_bits(spark, sf_dir):
    import numpy as np

    return spark.createDataFrame([(x, int(y)) for x, y in enumerate(hash_sources.spread_bits(np.arange(4096)).tolist())], "x long, spread long")


# probabilities of one bit of MinHash, of a search that stops inside a depth, and of the cross-polytope


@query(f"WITH {GRID} SELECT s, b::INT AS bits, round(CASE WHEN b = 0 THEN 1.0 ELSE s + (1 - s) * (100 / 2 - 1) / 99 END, 9) AS p FROM grid, generate_series(0, 2) h(b)")
def collision_prob_1bit_minhash(spark, sf_dir):
    p = families.MinHash1Bit.collision(100)
    return spark.createDataFrame([(i / 100, b, round(p(b, i / 100), 9)) for i in range(101) for b in range(3)], "s double, bits int, p double")


@query(f"WITH {GRID} SELECT s, d::INT AS depth, round((1 - {P1} ** d) ** 16 * CASE WHEN d < 24 THEN (1 - {P1} ** (d + 1)) ** 48 ELSE 1 END, 9) AS failure FROM grid, generate_series(1, 24) h(d)")
def failure_prob_partial(spark, sf_dir):
    """16 of 64 tables looked at to a depth, the others one bit deeper."""
    c = probability.concatenated_column(probability.simhash_column, 1)
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.round(probability.independent_failure_column(c, d, 64, F.col("s"), 16), 9).alias("failure")) for d in range(1, 25)])).alias("x")
    return grid(spark).select("s", each).select("s", "x.depth", "x.failure")


# sources


@query("SELECT 'w' || vec_id AS word, dim - 1 AS dim, embedding[dim] AS value FROM embeddings, generate_series(1, 64) g(dim)")
def word_vector_round_trip(spark, sf_dir):
    """Vectors written as lines of text and read again."""
    path = scratch_path(spark, "word-vectors")
    sources.write_word_vectors(vectors(spark, sf_dir).select(F.concat(F.lit("w"), "id").alias("word"), "features"), path)
    return sources.read_word_vectors(spark, path).select("word", F.posexplode("features").alias("dim", "value")).select("word", F.col("dim").cast("long").alias("dim"), "value")


@query()
def random_points(spark, sf_dir):
    return sources.random_vectors(spark, 500, 5).join(sources.random_sets(spark, 500, 100), "id")
