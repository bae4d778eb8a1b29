"""Registered queries of the index: its hashes against SQL that recomputes them, and searches that its tables answer.

The stored vectors have no close neighbours, so searches run on each of them four times: as it is, and with one
coordinate's sign changed. Queries are those whose vector's id is divisible by 20. At recall 0.9999 the answers
are the exact ones but for a chance below one in 10,000 for each neighbour, so plain SQL is their twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.numbers import key_of
from nearfield.operators import exact, families, hash_sources
from nearfield.session import persist_table, scratch_path

from .catalog import DIMENSIONS, DOC_SETS, EVERY_20TH, JACCARD, L2, QUERIES, UNIVERSE, asked_vectors, doc_sets, knn_sql, query, rounded, vectors
from .index import AnnIndex

SEED = 42
NEARLY_ALL = 0.9999
TABLES = 64

# the numbers that hash functions are made of, in SQL


def stream_sql(name: str, stream: int, count: int, seed: int = SEED) -> str:
    """CTEs of which the last, name (i, x), holds a stream's first values: mix(mix(i) ^ key)."""
    steps = ["(xor(x, x >> 16) * 2246822507::UBIGINT) & 4294967295::UBIGINT", "(xor(x, x >> 13) * 3266489909::UBIGINT) & 4294967295::UBIGINT", "xor(x, x >> 16)"]
    every = [*steps, f"xor(x, {int(key_of(seed, stream))}::UBIGINT)", *steps]
    out = [f"{name}0 AS (SELECT i, i::UBIGINT AS x FROM range(0, {count}) r(i))"]
    out += [f"{name if k == len(every) else name + str(k)} AS (SELECT i, {step} AS x FROM {name}{k - 1})" for k, step in enumerate(every, 1)]
    return ",\n".join(out)


def normals_sql(name: str, stream: int, count: int, seed: int = SEED) -> str:
    """CTEs of which the last, name (i, z), holds normal numbers."""
    return f"""{stream_sql(name + "w", stream, 2 * count, seed)},
{name} AS (SELECT a.i // 2 AS i, sqrt(-2 * ln((a.x + 0.5) / 4294967296)) * cos(2 * pi() * ((b.x + 0.5) / 4294967296)) AS z FROM {name}w a JOIN {name}w b ON b.i = a.i + 1 WHERE a.i % 2 = 0)"""


COORDS = f"c AS (SELECT vec_id AS id, g.m AS dim, embedding[g.m + 1]::DOUBLE AS v FROM embeddings, generate_series(0, {DIMENSIONS - 1}) g(m))"


def sides_sql(functions: int, stream: int = 1) -> str:
    """CTEs up to s (f, id, bit): the sides of that many hyperplanes."""
    return f"""WITH {normals_sql("n", stream, functions * DIMENSIONS)}, {COORDS},
s AS (SELECT n.i // {DIMENSIONS} AS f, c.id, (sum(n.z * c.v) >= 0)::INT AS bit FROM n JOIN c ON n.i % {DIMENSIONS} = c.dim GROUP BY ALL)"""


def table_rows(index: AnnIndex) -> DataFrame:
    return index.tables.select("table_id", "id", "hash")


def index_of(points: DataFrame, **options) -> AnnIndex:
    return AnnIndex(points.sparkSession, "angular", DIMENSIONS, **({"num_tables": TABLES} | options)).insert(points).rebuild()


SIMHASH = f"{sides_sql(4 * 24)}, h AS (SELECT (f // 24)::INT AS table_id, id, sum(bit << (23 - f % 24)::INT)::INT AS hash FROM s GROUP BY f // 24, id)"


@query(f"{SIMHASH} SELECT * FROM h")
def index_simhash_hashes(spark, sf_dir):
    return table_rows(index_of(vectors(spark, sf_dir), num_tables=4, hash_function="simhash"))


@query(f"{SIMHASH} SELECT table_id, hash >> 8 AS cell, count(*)::BIGINT AS size FROM h GROUP BY ALL")
def index_directory(spark, sf_dir):
    """Rows of the tables by their leading 16 bits."""
    return index_of(vectors(spark, sf_dir), num_tables=4, hash_function="simhash").directory()


POOL = 100


@query(
    f"""{sides_sql(POOL)}, {stream_sql("w", 1, 2 * POOL * DIMENSIONS + 4 * 24)},
d AS (SELECT (i - {2 * POOL * DIMENSIONS}) // 24 AS t, (i - {2 * POOL * DIMENSIONS}) % 24 AS b, x % {POOL} AS f FROM w WHERE i >= {2 * POOL * DIMENSIONS})
SELECT t::INT AS table_id, id, sum(bit << (23 - b)::INT)::INT AS hash FROM d JOIN s USING (f) GROUP BY t, id"""
)
def index_pool_hashes(spark, sf_dir):
    return table_rows(index_of(vectors(spark, sf_dir), num_tables=4, hash_function="simhash", hash_source="pool", source_args={"pool_size": POOL}))


@query(
    f"""{sides_sql(12 * 2 * 3)},
p AS (SELECT i, CASE WHEN k < r THEN k ELSE r END AS l, CASE WHEN k < r THEN r ELSE k - r END AS m FROM (SELECT i, floor(sqrt(i))::BIGINT AS r, i - floor(sqrt(i))::BIGINT ** 2 AS k FROM generate_series(0, 8) g(i)))
SELECT p.i::INT AS table_id, s.id, sum(bit << CASE WHEN f < 36 THEN (23 - 2 * (f % 12))::INT ELSE (22 - 2 * (f % 12))::INT END)::INT AS hash
FROM p JOIN s ON (f < 36 AND f // 12 = l) OR (f >= 36 AND f // 12 - 3 = m) GROUP BY p.i, s.id"""
)
def index_tensor_hashes(spark, sf_dir):
    """Nine tables from three left and three right halves of twelve bits, interleaved."""
    return table_rows(index_of(vectors(spark, sf_dir), num_tables=9, hash_function="simhash", hash_source="tensor"))


AXES = f"""a AS (SELECT *, row_number() OVER (PARTITION BY f, id ORDER BY abs(y) DESC, axis) AS k FROM y),
v AS (SELECT f, id, axis + CASE WHEN y < 0 THEN {DIMENSIONS} ELSE 0 END AS value FROM a WHERE k = 1)
SELECT (f // 4)::INT AS table_id, id, (sum(value << (7 * (3 - f % 4))::INT)::BIGINT >> 4)::INT AS hash FROM v GROUP BY f // 4, id"""


@query(
    f"""WITH {stream_sql("w", 1, 4 * 3 * DIMENSIONS)}, {COORDS},
g AS (SELECT i // {3 * DIMENSIONS} AS f, (i // {DIMENSIONS}) % 3 AS r, i % {DIMENSIONS} AS dim, 1 - 2 * (x % 2)::INT AS sign FROM w),
h AS (SELECT a::INT AS axis, b::INT AS dim, 1 - 2 * (bit_count((a & b)::BIGINT) % 2) AS sign FROM generate_series(0, {DIMENSIONS - 1}) p(a), generate_series(0, {DIMENSIONS - 1}) q(b)),
y0 AS (SELECT f, id, axis, sum(v * g.sign * h.sign) AS y FROM c JOIN g ON c.dim = g.dim AND r = 0 JOIN h ON h.dim = c.dim GROUP BY ALL),
y1 AS (SELECT y0.f, id, h.axis, sum(y * g.sign * h.sign) AS y FROM y0 JOIN g ON y0.f = g.f AND y0.axis = g.dim AND r = 1 JOIN h ON h.dim = y0.axis GROUP BY ALL),
y AS (SELECT y1.f, id, h.axis, sum(y * g.sign * h.sign) AS y FROM y1 JOIN g ON y1.f = g.f AND y1.axis = g.dim AND r = 2 JOIN h ON h.dim = y1.axis GROUP BY ALL), {AXES}"""
)
def index_fht_crosspolytope_hashes(spark, sf_dir):
    """Three rotations of sign flips and Hadamard transforms, four functions of seven bits for a table."""
    return table_rows(index_of(vectors(spark, sf_dir), num_tables=1))


@query(
    f"""WITH {normals_sql("n", 1, 4 * DIMENSIONS * DIMENSIONS)}, {COORDS},
y AS (SELECT n.i // {DIMENSIONS * DIMENSIONS} AS f, id, (n.i // {DIMENSIONS}) % {DIMENSIONS} AS axis, sum(z * v) / sqrt(sum(z * z)) AS y FROM n JOIN c ON n.i % {DIMENSIONS} = c.dim GROUP BY ALL), {AXES}"""
)
def index_crosspolytope_hashes(spark, sf_dir):
    return table_rows(index_of(vectors(spark, sf_dir), num_tables=1, hash_function="crosspolytope"))


def minhash_sql(functions: int, last: str) -> str:
    """CTEs up to m (f, id, value): the token of smallest hash, its low four bits permuted; 0 for an empty set. last follows."""
    words = 2 * functions * 4 * 256
    return f"""WITH {DOC_SETS}, {stream_sql("w", 1, words + 16 * functions)},
e AS (SELECT i // 2048 AS f, (i // 512) % 4 AS byte, (i // 2) % 256 AS value, x FROM w WHERE i < {words} AND i % 2 = 0),
k AS (SELECT t AS token, a.f, xor(xor(a.x, b.x), xor(y.x, z.x)) AS hash FROM generate_series(0, {UNIVERSE - 1}) g(t)
  JOIN e a ON a.byte = 0 AND a.value = t % 256 JOIN e b ON b.f = a.f AND b.byte = 1 AND b.value = t // 256 JOIN e y ON y.f = a.f AND y.byte = 2 AND y.value = 0 JOIN e z ON z.f = a.f AND z.byte = 3 AND z.value = 0),
l AS (SELECT f, id, arg_min(token, (hash, token)) AS token FROM (SELECT id, unnest(tokens) AS token FROM d) JOIN k USING (token) GROUP BY f, id),
p AS (SELECT (i - {words}) // 16 AS f, (i - {words}) % 16 AS moved, row_number() OVER (PARTITION BY (i - {words}) // 16 ORDER BY x, i) - 1 AS low FROM w WHERE i >= {words}),
m AS (SELECT f, id, token - low + moved AS value FROM l JOIN p USING (f) WHERE token % 16 = low
  UNION ALL SELECT f, id, 0 FROM d, generate_series(0, {functions - 1}) g(f) WHERE len(tokens) = 0)
{last}"""


@query(minhash_sql(4, "SELECT (f // 2)::INT AS table_id, id, sum(value << (12 * (1 - f % 2))::INT)::INT AS hash FROM m GROUP BY f // 2, id"))
def index_minhash_hashes(spark, sf_dir):
    return table_rows(AnnIndex(spark, "jaccard", UNIVERSE, num_tables=2).insert(doc_sets(spark, sf_dir)).rebuild())


@query(minhash_sql(24, "SELECT 0 AS table_id, id, sum((value % 2) << (23 - f)::INT)::INT AS hash FROM m GROUP BY id"))
def index_1bit_minhash_hashes(spark, sf_dir):
    return table_rows(AnnIndex(spark, "jaccard", UNIVERSE, num_tables=1, hash_function="1bit_minhash").insert(doc_sets(spark, sf_dir)).rebuild())


@query(
    f"""{sides_sql(2 * 64, 2)}, h AS (SELECT id, f // 64 AS n, (f // 32) % 2 AS half, sum(bit::BIGINT << (31 - f % 32)::INT)::BIGINT AS x FROM s GROUP BY ALL)
SELECT id, n::INT AS n, max(x) FILTER (half = 0) AS high, max(x) FILTER (half = 1) AS low FROM h GROUP BY id, n"""
)
def index_sketches(spark, sf_dir):
    """The first two sketches of each point, in halves."""
    x = index_of(vectors(spark, sf_dir), num_tables=1).built.select("id", F.posexplode(F.slice("sketches", 1, 2)).alias("n", "x"))
    return x.select("id", "n", F.shiftrightunsigned("x", 32).alias("high"), F.col("x").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))


@query(
    f"""WITH {normals_sql("n", 77, 9 * 2 * 40 * 8, 5)},
z AS (SELECT i // 640 AS step, (i // 320) % 2 AS w, (i // 8) % 40 AS rep, i % 8 AS dim, z FROM n),
b AS (SELECT a.step, a.rep, a.dim, a.z AS one, least(1.0, -1 + 0.25 * a.step) * a.z + sqrt(greatest(0, 1 - least(1.0, -1 + 0.25 * a.step) ** 2)) * b.z AS two FROM z a JOIN z b USING (step, rep, dim) WHERE a.w = 0 AND b.w = 1),
x AS (SELECT step, rep, arg_max(dim + CASE WHEN one < 0 THEN 8 ELSE 0 END, abs(one)) AS p, arg_max(dim + CASE WHEN two < 0 THEN 8 ELSE 0 END, abs(two)) AS q FROM b GROUP BY step, rep)
SELECT step::INT AS step, k::INT AS bits, round(avg((p::BIGINT >> (4 - k)::INT = q::BIGINT >> (4 - k)::INT)::INT), 9) AS p FROM x, generate_series(1, 4) g(k) GROUP BY step, k"""
)
def collision_prob_crosspolytope(spark, sf_dir):
    """The estimated table of eight dimensions, in steps of an eighth, from 40 repetitions."""
    table = families.CrossPolytopeEstimate(8, 40, 0.125, 5).table
    return spark.createDataFrame([(i, b, round(float(table[b, i]), 9)) for b in range(1, 5) for i in range(9)], "step int, bits int, p double")


@query(
    """WITH n AS (SELECT count(*) AS n FROM embeddings), m AS (SELECT (10 ** e)::BIGINT AS memory_limit, n * (2 * 64 + 256) AS fixed, 24 * 2 * 64 + 4 * (2 ** 13 + 1) + 8 * 24 + 8 * n AS each FROM n, generate_series(7, 10) g(e))
SELECT memory_limit, (ceil((memory_limit - fixed) / each) - 1)::INT AS tables FROM m"""
)
def tables_for_memory(spark, sf_dir):
    """The most tables whose size, with points, sketches and functions, stays below a limit; below zero where the points alone exceed it."""
    n = vectors(spark, sf_dir).count()
    return spark.createDataFrame([(10**e, hash_sources.tables_within(10**e, n, 2 * DIMENSIONS, families.SimHash, DIMENSIONS)) for e in range(7, 11)], "memory_limit long, tables int")


@query("SELECT n AS inserted, n AS searchable, n // 2 AS before, 8 AS tables, 0::BIGINT AS cleared, 0 AS tables_cleared FROM (SELECT count(*)::BIGINT AS n FROM embeddings WHERE vec_id % 2 = 0) UNION ALL SELECT 0, 0, 0, 0, 0, 0 WHERE false")
def index_counts(spark, sf_dir):
    """Points and tables of an index as it is filled, rebuilt and cleared."""
    v = vectors(spark, sf_dir).where("id % 2 = 0")
    n = v.count()
    index = AnnIndex(spark, "angular", DIMENSIONS, num_tables=8).insert(v.orderBy("id").limit(n // 2)).rebuild()
    before = index.count()
    index.insert(v.join(index.points(), "id", "left_anti")).rebuild()
    row = (index.count(), index.built.count(), before, index.get_repetitions())
    index.clear()
    return spark.createDataFrame([(*row, index.count(), index.get_repetitions())], "inserted long, searchable long, before long, tables int, cleared long, tables_cleared int")


# searches that the tables answer

FLIPS = 4


def flips(spark, sf_dir) -> DataFrame:
    """Each vector as it is and with the sign of coordinate 16, 32 or 48 changed; ids are 4 * vec_id + r."""
    v = vectors(spark, sf_dir).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(FLIPS - 1))))
    changed = F.transform("features", lambda x, i: F.when((F.col("r") > 0) & (i == 16 * F.col("r") - 1), -x).otherwise(x))
    return v.select((FLIPS * F.col("id") + F.col("r")).alias("id"), changed.alias("features"))


def asked_flips(spark, sf_dir) -> DataFrame:
    return flips(spark, sf_dir).where(f"id % {FLIPS * 20} = 0").withColumnRenamed("id", "query_id")


FLIPS_SQL = f"""e AS (SELECT {FLIPS} * vec_id + r AS id, list_transform(range(1, {DIMENSIONS + 1}), lambda i: CASE WHEN r > 0 AND i = 16 * r THEN -embedding[i]::DOUBLE ELSE embedding[i]::DOUBLE END) AS v
FROM embeddings, generate_series(0, {FLIPS - 1}) g(r))"""


def flips_sql(k: int = 4, exclude_self: bool = False, similar: str = "(list_cosine_similarity(q.v, p.v) + 1) / 2", source: str = FLIPS_SQL) -> str:
    return f"""WITH {source},
s AS (SELECT q.id AS query_id, p.id AS id, {similar} AS s FROM e q, e p WHERE q.id % {FLIPS * 20} = 0 {"AND q.id <> p.id" if exclude_self else ""}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id DESC) AS rank FROM s WHERE s > 0)
SELECT query_id, id, round(s, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= {k}"""


@query(flips_sql())
def knn_lsh_search(spark, sf_dir):
    return rounded(index_of(flips(spark, sf_dir)).search(asked_flips(spark, sf_dir), 4, NEARLY_ALL, "none"))


@query(flips_sql())
def knn_lsh_crosspolytope(spark, sf_dir):
    return rounded(index_of(flips(spark, sf_dir), hash_function="crosspolytope", num_tables=48).search(asked_flips(spark, sf_dir), 4, NEARLY_ALL, "none"))


@query(flips_sql())
def knn_lsh_tensor_simhash(spark, sf_dir):
    return rounded(index_of(flips(spark, sf_dir), hash_function="simhash", hash_source="tensor", num_tables=100).search(asked_flips(spark, sf_dir), 4, NEARLY_ALL, "none"))


@query(flips_sql())
def knn_lsh_pool(spark, sf_dir):
    return rounded(index_of(flips(spark, sf_dir), hash_function="simhash", hash_source="pool", source_args={"pool_size": 700}).search(asked_flips(spark, sf_dir), 4, NEARLY_ALL, "none"))


@query(flips_sql(3, exclude_self=True))
def knn_lsh_from_index(spark, sf_dir):
    """Neighbours of stored points, which are not their own."""
    index = index_of(flips(spark, sf_dir), hash_function="simhash")
    return rounded(index.search_from_index(asked_flips(spark, sf_dir).withColumnRenamed("query_id", "id"), 3, NEARLY_ALL, "none"))


Q15_SQL = f"""{FLIPS_SQL.replace("e AS", "u AS")}, e AS (SELECT id, list_transform(v, lambda x: greatest(least(trunc(x / sqrt(list_sum(list_transform(v, lambda y: y * y))) * 32768), 32767), -32768)) AS v FROM u)"""


@query(flips_sql(source=Q15_SQL))
def knn_lsh_q15(spark, sf_dir):
    """Points and queries kept as 16-bit codes."""
    return rounded(index_of(flips(spark, sf_dir), hash_function="simhash", storage="q15").search(asked_flips(spark, sf_dir), 4, NEARLY_ALL, "none"))


@query(flips_sql())
def incremental_append_search(spark, sf_dir):
    """Half the points, a rebuild, the other half, another rebuild, then a search over both segments."""
    v = flips(spark, sf_dir)
    index = index_of(v.where("id % 2 = 0"), hash_function="simhash").insert(v.where("id % 2 = 1")).rebuild()
    return rounded(index.search(asked_flips(spark, sf_dir), 4, NEARLY_ALL, "none"))


@query(flips_sql())
def save_load_search(spark, sf_dir):
    path = scratch_path(spark, "saved-index")
    index_of(flips(spark, sf_dir), hash_function="simhash").save(path)
    return rounded(AnnIndex.load(spark, path).search(asked_flips(spark, sf_dir), 4, NEARLY_ALL, "none"))


PAIRS = 10


@query(
    f"""WITH {FLIPS_SQL}, s AS (SELECT q.id AS id_a, p.id AS id_b, (list_cosine_similarity(q.v, p.v) + 1) / 2 AS s FROM e q JOIN e p ON q.id // {FLIPS} = p.id // {FLIPS} AND q.id < p.id)
SELECT id_a, id_b, round(s, 6) AS similarity, row_number() OVER (ORDER BY s DESC, id_a DESC, id_b DESC)::INT AS rank FROM s ORDER BY s DESC, id_a DESC, id_b DESC LIMIT {PAIRS}"""
)
def closest_pairs_lsh(spark, sf_dir):
    """The closest pairs are among the variants of a vector, so SQL compares those; closest_pairs_cosine_bf compares all pairs."""
    return rounded(index_of(flips(spark, sf_dir)).closest_pairs(PAIRS, NEARLY_ALL))


@query(
    f"""WITH {DOC_SETS}, e AS (SELECT 2 * id AS id, tokens FROM d UNION ALL SELECT 2 * id + 1, tokens[2:] FROM d),
s AS (SELECT a.id AS query_id, c.id AS id, {JACCARD} AS s FROM e a, e c WHERE a.id % 40 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id DESC) AS rank FROM s WHERE s > 0)
SELECT query_id, id, round(s, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 2"""
)
def knn_lsh_jaccard(spark, sf_dir):
    """Each document's words, and the same without the first; the two nearest of every 20th document's."""
    return rounded(sets_index(spark, sf_dir).search(asked_sets(spark, sf_dir), 2, NEARLY_ALL, "none"))


def variants(spark, sf_dir) -> DataFrame:
    d = persist_table(doc_sets(spark, sf_dir), "document-sets")
    return d.select((2 * F.col("id")).alias("id"), "tokens").unionByName(d.select((2 * F.col("id") + 1).alias("id"), F.expr("slice(tokens, 2, size(tokens))").alias("tokens")))


def sets_index(spark, sf_dir, **options) -> AnnIndex:
    return AnnIndex(spark, "jaccard", UNIVERSE, **({"num_tables": 32} | options)).insert(variants(spark, sf_dir)).rebuild()


def asked_sets(spark, sf_dir) -> DataFrame:
    return doc_sets(spark, sf_dir).where(EVERY_20TH).select((2 * F.col("id")).alias("query_id"), "tokens")


# how the searches came about

SETTINGS = (
    ("fht_crosspolytope", "independent", "default"), ("fht_crosspolytope", "tensor", "simple"), ("crosspolytope", "independent", "simple"),
    ("simhash", "independent", "default"), ("simhash", "pool", "default"), ("simhash", "tensor", "none"),
)
RECALLS = (0.5, 0.8, 0.95)
#: Tensored tables depend on each other, so there are more of them.
MORE = {"pool": {"source_args": {"pool_size": 700}}, "tensor": {"num_tables": 196}}


@query(f"SELECT * FROM (VALUES {', '.join(str(x) for x in SETTINGS)}) s(family, source, filter), (VALUES {', '.join(f'({r}::DOUBLE)' for r in RECALLS)}) r(recall), (SELECT true AS reached, true AS from_tables)")
def recall_by_setting(spark, sf_dir):
    """Whether a search finds the asked share of the four nearest, and whether the tables answered nine of ten queries."""
    points, asked = persist_table(flips(spark, sf_dir), "flips"), persist_table(asked_flips(spark, sf_dir), "flips-asked")
    truth = persist_table(exact.knn(points, asked, 4).select("query_id", "id"), "flips-truth")
    n, rows = truth.count(), []
    for family, source, kind in SETTINGS:
        index = index_of(points, hash_function=family, hash_source=source, **MORE.get(source, {}))
        for recall in RECALLS:
            index.clear_metrics()
            found = index.search(asked, 4, recall, kind)
            share = found.join(truth, ["query_id", "id"], "left_semi").count() / n
            rows.append((family, source, kind, recall, share >= recall, _from_tables(index) >= 0.9))
    return spark.createDataFrame(rows, "family string, source string, filter string, recall double, reached boolean, from_tables boolean")


def _from_tables(index: AnnIndex) -> float:
    """Share of the queries that were finished above depth 0, by the index's own counts."""
    rows = index.query_metrics().groupBy((F.col("depth") > 0).alias("deep")).agg(F.sum("finished").alias("n")).collect()
    return sum(r.n for r in rows if r.deep) / max(1, sum(r.n for r in rows))


@query("SELECT count(*)::BIGINT AS queries, count(*)::BIGINT AS finished, true AS from_tables, true AS fewer_candidates FROM embeddings WHERE vec_id % 20 = 0")
def search_metrics(spark, sf_dir):
    """Queries asked and finished, whether the tables answered nine of ten, and whether they met fewer points than brute force."""
    index = index_of(flips(spark, sf_dir), hash_function="simhash")
    index.search(asked_flips(spark, sf_dir), 4, 0.9)
    all_pairs = index.built_count * asked_flips(spark, sf_dir).count()
    m = index.query_metrics().agg(F.max("queries").alias("queries"), F.sum("finished").alias("finished"), F.sum(F.when(F.col("depth") > 0, F.col("candidates"))).alias("met"))
    return m.select("queries", "finished", F.lit(_from_tables(index) >= 0.9).alias("from_tables"), (F.col("met") < all_pairs).alias("fewer_candidates"))


@query("SELECT true AS same")
def closest_pairs_jaccard_lsh(spark, sf_dir):
    """Whether the index finds pairs as close as brute force does; many pairs are equally close, so their ids may differ.

    In small collections buckets of common words hold so many pairs that all are compared; tests see to pairs from tables."""
    index = sets_index(spark, sf_dir)
    found = index.closest_pairs(PAIRS, NEARLY_ALL).agg(F.sort_array(F.collect_list(F.round("similarity", 6))).alias("found"))
    want = index.closest_pairs_bf(PAIRS).agg(F.sort_array(F.collect_list(F.round("similarity", 6))).alias("want"))
    return found.join(want).select((F.col("found") == F.col("want")).alias("same"))


@query(knn_sql(L2))
def index_l2_bf(spark, sf_dir):
    """An index of vectors as they are, searched exactly by distance."""
    return rounded(AnnIndex(spark, "l2", DIMENSIONS).insert(vectors(spark, sf_dir)).search_bf(asked_vectors(spark, sf_dir), 10))


@query("SELECT vec_id AS id, dim - 1 AS dim, greatest(least(trunc(embedding[dim]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) * 32768), 32767), -32768)::SMALLINT AS code FROM embeddings, generate_series(1, 64) g(dim) WHERE vec_id % 20 = 0")
def index_get_q15(spark, sf_dir):
    """Stored points by id from an index of 16-bit codes."""
    index = AnnIndex(spark, "angular", DIMENSIONS, storage="q15").insert(vectors(spark, sf_dir))
    ids = [r.query_id for r in asked_vectors(spark, sf_dir).select("query_id").collect()]  # the stated query set
    return index.get(*ids).select("id", F.posexplode("features").alias("dim", "code")).select("id", F.col("dim").cast("long").alias("dim"), "code")

#: All queries of the similarity engine, those of the catalog too.
REGISTERED = QUERIES
