"""Approximate search and closest pairs with a recall guarantee, by prefixes as long as the answers allow.

A search looks at the tables three times at most. First at whole hashes: the similarity of the kth best point found is
a lower bound of what the kth neighbour's will be. From it follow the longest prefix, and the fewest tables at
that length, for which the chance to have missed a point as similar is at most 1 - recall. Queries whose bound asks for
no look much shallower than START, at which buckets hold a few points, go on from there; the others are looked up at START.
Queries for which the look so far was that deep are finished; for the others another looks exactly that deep, and they are
finished too, as another look can only raise the bound. Queries that would meet more than WORTH of all points are
searched exactly instead, as is everything in a collection of fewer than SMALL points.

Filters: "none" compares every candidate, at whole depths; "simple" drops candidates whose sketches differ by
more bits than the bound allows and looks at whole depths; "default" does so too and stops inside a depth, with the
rest of the tables looked at one bit deeper. The guarantee is that of "none" with independent or tensored
tables; sketches and the pool lower it slightly.

Closest pairs are found likewise: buckets of the tables are compared as blocks, each task keeping its k best
pairs, of sets first by the hashes of all tables at once, then by whole hashes of a few tables, or as many as the kth best pair asks for, else at a depth of a few points in each bucket and then as deep as the kth best pair asks for.
Passes end in tables in the shared folder.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import probability
from nearfield.session import persist_table

from . import exact
from .hash_sources import DEPTH, Source
from .tables import prefix, ranged_candidates, ranged_counts, table_rows

FILTERS = ("default", "none", "simple")
#: Fewer points than these are searched exactly.
SMALL = 100
#: Points that a bucket of the first pass holds on average.
BUCKET = 16
#: Bits by which a look may be shallower than the first pass for the first pass to be left out.
SPARED = 2
#: Share of all comparisons beyond which candidates are not worth gathering.
WORTH = 0.25
#: Tables whose whole hashes a search for the closest pairs looks at first.
FEW = 4
#: Candidates that are compared at once, and marks of queries' tokens.
COMPARED = 1024
MARKS = 4_000_000
#: The same for sets, which exact search compares many at a time in products; and candidates that are worth it in any collection.
WORTH_SETS = 1 / 64
FEW_CANDIDATES = 1024
SMALL_SETS = 10_000
#: Steps of the grid of similarities.
STEPS = 1000


def _common(ids: np.ndarray, p: pa.Array, q: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that the sets of p share with those of q, row by row, and their union's size; rows of one id have the same q."""
    (a, a_starts), (b, b_starts) = exact.tokens_of(p), exact.tokens_of(q)
    distinct, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    _, first, own = np.unique(ids, return_index=True, return_inverse=True)
    sizes, asked = np.diff(a_starts), np.diff(b_starts)
    common = np.zeros(len(ids))
    # a line of marks for each query, so many queries at a time
    lines = max(1, MARKS // max(1, len(distinct)))
    token_row = np.repeat(np.arange(len(ids)), sizes)
    for low in range(0, len(first), lines):
        marks = np.zeros((min(lines, len(first) - low), len(distinct)), bool)
        for i, r in enumerate(first[low : low + lines]):
            marks[i, place[len(a) + b_starts[r] : len(a) + b_starts[r + 1]]] = True
        mine = own[token_row] - low
        some = (mine >= 0) & (mine < len(marks))
        met = marks[mine[some], place[: len(a)][some]]
        common += np.bincount(token_row[some][met], minlength=len(ids))
    return common, sizes + asked - common


def _task_compare(metric: str, stored: str) -> Callable:
    """(query_id, id, similarity) of rows (query_id, id, p, q), those above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, COMPARED) for b in batches for at in range(0, b.num_rows, COMPARED)):
            p, q = (pa.concat_arrays([batch.column(i)]) for i in (2, 3))
            if metric == "jaccard":
                common, union = _common(batch.column(0).to_numpy(), p, q)
                s = np.divide(common, union, out=np.zeros(len(common)), where=union > 0)
            else:
                a, b = exact.matrix_of(p), exact.matrix_of(q)
                s = np.einsum("ij,ij->i", a, b)
                if stored == "q15":
                    norm = np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
                    s = np.divide(s, norm, out=np.zeros_like(s), where=norm > 0)
                s = np.clip((s + 1) / 2, 0, 1)
            keep = pa.array(s > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(s[s > 0])], names=["query_id", "id", "similarity"])

    return run


def start_depth(n: int) -> int:
    """Bits at which buckets hold BUCKET points on average."""
    return max(1, min(DEPTH, math.ceil(math.log2(max(2, n / BUCKET)))))


def depth_needed(source: Source, s: float, recall: float, partial: bool = False) -> tuple[int, int]:
    """The greatest depth, and at it the fewest tables (all unless partial), that miss a point of similarity s with chance 1 - recall at most.

    (0, 0) where no depth does. Tables beyond the fewest are looked at one bit deeper.
    """
    most = 1 - recall
    low, high = 0, DEPTH + 1  # the failure grows with the depth
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if source.failure(middle, s) <= most else (low, middle)
    if not low:
        return 0, 0
    few, enough = 0, source.tables
    while partial and enough - few > 1:
        middle = (few + enough) // 2
        few, enough = (few, middle) if source.failure(low, s, middle) <= most else (middle, enough)
    return low, enough


def _by_similarity(values: list[int], s) -> object:
    """The value of the grid point below s."""
    return F.element_at(F.expr("array(" + ",".join(map(str, values)) + ")"), F.floor(s * STEPS).cast("int") + 1)


def _limits(collision) -> list[int]:
    """Differing sketch bits allowed on the grid of similarities."""
    return [probability.sketch_threshold(collision, i / STEPS) for i in range(STEPS + 1)]


def search(
    points: DataFrame, sketched: Callable[[], DataFrame], n: int, queries: DataFrame, source: Source, sketch_collision, k: int, recall: float, metric: str, column: str, filter_type: str = "default", exclude_self: bool = False, trace: list[dict] | None = None, stored: str = "double"
) -> DataFrame:
    """query_id, id, similarity, rank. trace gets a row for each pass: depth, candidates, queries, finished, seconds.

    points: id, column, hashes, n of them; sketched gives the same with sketches; queries: query_id, column, hashes,
    and sketches unless the filter is "none".
    """
    if filter_type not in FILTERS:
        raise ValueError(f"unknown filter type {filter_type!r}")
    if not 0 <= recall <= 1:
        raise ValueError("recall must be between 0 and 1")
    spark = points.sparkSession
    if k <= 0:
        return spark.createDataFrame([], "query_id long, id long, similarity double, rank int")
    if n < SMALL or recall >= 1:
        return exact.knn(points, queries, k, metric, column, exclude_self)
    trace = [] if trace is None else trace
    filtered = filter_type != "none"
    queries = persist_table(queries.select("query_id", column, "hashes", *(["sketches"] if filtered else [])), "search-queries")
    asked = queries.count()
    start = start_depth(n)
    limits = _limits(sketch_collision)
    compare = _task_compare(metric, stored)

    def counts(rows: DataFrame) -> DataFrame:
        """query_id and work, the points that rows (query_id, depth, tables) reach."""
        found = ranged_counts(rows, queries.select("query_id", "hashes"), points, source.tables)
        return rows.join(found, "query_id", "left").withColumn("work", F.coalesce("work", F.lit(0)))

    def look(rows: DataFrame, before: DataFrame | None) -> DataFrame:
        """The k best of the points that rows (query_id, depth, tables, kth) reach and of those found before."""
        narrow = filtered and before is not None  # without a bound every sketch passes
        rows = rows.withColumn("limit", _by_similarity(limits, F.col("kth"))) if narrow else rows
        found = ranged_candidates(rows, queries, sketched() if narrow else points, source.tables, column, compare, k, exclude_self, narrow)
        if before is not None:
            found = persist_table(found, "search-found")
            found = found.unionByName(before.select("query_id", "id", "similarity").join(found.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti"))
        return persist_table(exact.top_k(found, k), "search-top")

    def at(rows: DataFrame, depth: int) -> DataFrame:
        """All tables of the queries to one depth."""
        return rows.select("query_id", F.lit(depth).alias("depth"), F.lit(source.tables).alias("tables"))

    began = time.perf_counter()
    plan = [depth_needed(source, i / STEPS, recall, filter_type == "default") for i in range(STEPS + 1)]
    # where even uniform tables would hold too many points, the rest is searched exactly
    plan = [(d, j) if d and j * 2.0**-d + (source.tables - j) * 2.0 ** -(d + 1) <= WORTH else (0, 0) for d, j in plan]

    worthwhile = max(WORTH_SETS * n, min(WORTH * n, FEW_CANDIDATES)) if metric == "jaccard" else WORTH * n

    def bounded(found: DataFrame) -> DataFrame:
        """query_id, kth, depth, tables: what the kth best found asks for."""
        kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(0.0).alias("kth"))
        return kth.withColumn("depth", _by_similarity([d for d, _ in plan], F.col("kth"))).withColumn("tables", _by_similarity([j for _, j in plan], F.col("kth")))

    # queries that meet too many points even by whole hashes are not looked up; without copies of points few do
    many = worthwhile if metric == "jaccard" and n > SMALL_SETS else max(WORTH * n, 64.0 * BUCKET * source.tables)
    whole = persist_table(counts(at(queries, DEPTH)).where(F.col("work") <= many).select("query_id", "work"), "search-whole")
    deep = look(at(whole, DEPTH), None)
    # those that need hardly a shallower look than the first pass would be are spared it
    known = persist_table(bounded(deep).where((F.col("depth") >= max(1, start - SPARED))), "search-deep")
    left = (whole if metric == "jaccard" and n > SMALL_SETS else queries).join(known.select("query_id"), "query_id", "left_anti")
    # queries in crowded buckets go on from whole hashes; the second pass sees to the rest
    first = persist_table(counts(at(left, start)), "search-first")
    crowded = F.col("work") > 64 * BUCKET * source.tables
    shallow = look(at(first.where(~crowded), start), None)
    top = deep.join(shallow.select("query_id").distinct(), "query_id", "left_anti").unionByName(shallow)
    seen = first.where(~crowded).select("query_id", "work", F.lit(start).alias("seen"))
    seen = seen.unionByName(whole.join(seen.select("query_id"), "query_id", "left_anti").select("query_id", "work", F.lit(DEPTH).alias("seen")))
    state = queries.select("query_id").join(bounded(top), "query_id", "left").join(seen, "query_id", "left")
    state = state.select("query_id", F.coalesce("kth", F.lit(0.0)).alias("kth"), F.coalesce("work", F.lit(0)).alias("work"), F.coalesce("seen", F.lit(DEPTH + 1)).alias("seen"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("tables", F.lit(0)).alias("tables"))
    state = persist_table(state.withColumn("done", F.col("depth") >= F.col("seen")), "search-state")
    finished, work = state.agg(F.count(F.when(F.col("done"), 1)), F.sum("work")).first()
    trace.append({"depth": start, "candidates": work or 0, "queries": asked, "finished": finished, "seconds": time.perf_counter() - began})
    answers = [top.join(state.where("done").select("query_id"), "query_id", "left_semi")]
    left = asked - finished
    if left:
        began = time.perf_counter()
        rows = counts(state.where("not done and depth > 0").select("query_id", "kth", "depth", "tables"))
        worth = persist_table(rows.where(F.col("work") <= worthwhile), "search-worth")
        second, work, depth = worth.agg(F.count("*"), F.sum("work"), F.min("depth")).first()
        if second:
            answers.append(look(worth, top.join(worth.select("query_id"), "query_id", "left_semi")))
            trace.append({"depth": depth, "candidates": work, "queries": left, "finished": second, "seconds": time.perf_counter() - began})
            left -= second
        if left:
            began = time.perf_counter()
            rest = queries.join(state.where("not done").select("query_id"), "query_id", "left_semi").join(worth.select("query_id"), "query_id", "left_anti")
            answers.append(exact.knn(points, rest, k, metric, column, exclude_self))
            trace.append({"depth": 0, "candidates": left * n, "queries": left, "finished": left, "seconds": time.perf_counter() - began})
    out = None
    for part in answers:
        part = part.select("query_id", "id", "similarity", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def closest_pairs(points: DataFrame, source: Source, k: int, recall: float, metric: str, column: str, trace: list[dict] | None = None) -> DataFrame:
    """id_a < id_b, similarity, rank of the k closest pairs. trace gets a row for each pass, with pairs compared as its candidates.

    Of equal points only the k + 1 of highest id take part, so copies do not multiply pairs.
    """
    if not 0 <= recall <= 1:
        raise ValueError("recall must be between 0 and 1")
    n = points.count()
    if k <= 0 or n < SMALL or recall >= 1:
        return exact.closest_pairs(points, k, metric, column)
    trace = [] if trace is None else trace
    cores = points.sparkSession.sparkContext.defaultParallelism
    some = persist_table(exact.highest_of_equal(points.select("id", F.col(column).alias("point")), k, "point"), "pairs-points")
    every = n
    _, n, size = exact.measured(some, "point", metric)
    hashed = points.select("id", "hashes")
    hashed = hashed if n == every else persist_table(hashed.join(some.select("id"), "id", "left_semi"), "pairs-hashes")
    block = exact.pair_block(n, size, cores)

    def entries(few: int) -> DataFrame:
        """The first few tables, of which the others' hashes are not read out; of 0 tables one whose hash is that of all tables' hashes."""
        if not few:
            return hashed.select(F.lit(0).alias("table_id"), F.xxhash64(F.slice("hashes", 1, source.tables)).alias("hash"), "id")
        return table_rows(hashed.select("id", F.slice("hashes", 1, few).alias("hashes")))

    def bucket(depth: int, few: int):
        return (prefix(F.col("hash"), depth) if few else F.col("hash")).alias("p")

    def pairs_at(depth: int, few: int = source.tables) -> int:
        sizes = entries(few).groupBy("table_id", bucket(depth, few)).agg(F.count("*").cast("double").alias("size"))
        return int(sizes.agg(F.sum(F.col("size") * (F.col("size") - 1) / 2)).first()[0] or 0)

    def look(depth: int, few: int = source.tables) -> DataFrame:
        """The best pairs of all buckets of the first few tables; buckets above a block are dealt into parts, and each pair of parts is compared."""
        keyed = entries(few).select("table_id", bucket(depth, few), "id")
        sizes = keyed.groupBy("table_id", "p").agg(F.count("*").alias("size")).where("size > 1")
        dealt = keyed.join(sizes, ["table_id", "p"]).withColumn("parts", F.ceil(F.col("size") / block).cast("int"))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        tasks = dealt.join(some, "id").select(
            F.xxhash64("table_id", "p", F.least("own", "other"), F.greatest("own", "other")).alias("pair"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "point"
        )
        found = tasks.repartition("pair").sortWithinPartitions("pair", "side", "id").mapInArrow(exact._task_pairs(metric, k), "id_a long, id_b long, similarity double")
        return persist_table(exact.best_pairs(found, k), "pairs-top")

    depth, most = start_depth(n), WORTH * n * (n - 1) / 2
    if metric == "jaccard":
        # equal sets, and few others, share the hashes of all tables; no pair is closer, and where there are k such pairs no bucket of one table's hash is compared
        began = time.perf_counter()
        work = pairs_at(DEPTH, 0)
        if work <= most:
            top = look(DEPTH, 0)
            count, kth = top.agg(F.count("*"), F.min("similarity")).first()
            done = count >= k and kth >= 1
            trace.append({"depth": DEPTH, "candidates": work, "queries": 1, "finished": int(done), "seconds": time.perf_counter() - began})
            if done:
                return top
    # whole hashes of a few tables first: for pairs as close as the best ones may be these are enough, and each table looked at moves the points
    few = min(FEW, source.tables)
    while few:
        began = time.perf_counter()
        work = pairs_at(DEPTH, few)
        if work > most:
            break
        top = look(DEPTH, few)
        count, kth = top.agg(F.count("*"), F.min("similarity")).first()
        need, enough = depth_needed(source, kth if count >= k else 0.0, recall, True)
        done = need == DEPTH and enough <= few
        trace.append({"depth": DEPTH, "candidates": work, "queries": 1, "finished": int(done), "seconds": time.perf_counter() - began})
        if done:
            return top
        few = enough if need == DEPTH else 0
    # buckets may be uneven: the first pass goes as deep as it takes for points to meet about BUCKET others in a table
    while depth < DEPTH and pairs_at(depth) > min(most, 2.0 * BUCKET * n * source.tables):
        depth = min(DEPTH, depth + 2)
    seen = None
    while True:
        began = time.perf_counter()
        work = pairs_at(depth)
        if work > most:
            break
        top = look(depth)
        count, kth = top.agg(F.count("*"), F.min("similarity")).first()
        need = depth_needed(source, kth if count >= k else 0.0, recall)[0]
        trace.append({"depth": depth, "candidates": work, "queries": 1, "finished": int(need >= depth), "seconds": time.perf_counter() - began})
        if need >= depth:
            return top
        if need == seen or source.tables * 2.0**-need > WORTH:
            break
        depth = seen = need
    began = time.perf_counter()
    out = exact.closest_pairs(points, k, metric, column)
    trace.append({"depth": 0, "candidates": n * (n - 1) // 2, "queries": 1, "finished": 1, "seconds": time.perf_counter() - began})
    return out
