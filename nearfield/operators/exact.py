"""Exact nearest neighbours and closest pairs.

Queries are a stated set: they go to the executors in blocks of bounded bytes and meet all points in
matrix products over Arrow batches. A task keeps the k best of each query, so what is shuffled is k rows
for each query and task. Points of similarity 0 are never results; ties go to the higher id.

All-pairs search deals the points into blocks of bounded bytes and gives each pair of blocks to a task that
keeps its k best pairs; of points that are equal only the k + 1 of highest id can be in a result, and only
those take part.

Points that are null or have no id are left out, null tokens too; a vector with a null or of another length
than the others is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.session import persist_table

#: Bytes of the vectors or tokens in a block of queries, which is broadcast, and in a block of an all-pairs search.
QUERY_BYTES = 32 << 20
PAIR_BYTES = 16 << 20
#: Bytes of the matrix of a block's common tokens; a token is common if one set in COMMON has it.
MATRIX_BYTES = 64 << 20
COMMON = 64
#: Pairs that are compared at once.
CELLS = 1_000_000
#: Tasks of an all-pairs search at most.
PAIR_TASKS = 4_000
METRICS = ("angular", "l2", "jaccard")


def matrix_of(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten()
    if flat.null_count or (n and len(np.unique(np.diff(column.offsets.to_numpy()))) > 1):
        raise ValueError("vectors must be of one length and hold no nulls")
    flat = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each set, flat, with row starts."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    if not len(flat):
        return flat, np.zeros(len(column) + 1, dtype=np.int64)
    order = np.lexsort((flat, row))
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])])
    flat, row = flat[new], row[new]
    return flat, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(column)))])


class Block:
    """A set of points that batches of points are compared with.

    Scores rise with similarity and are cheap: single-precision products of vectors, true to margin, or the Jaccard
    similarities themselves. Few pairs pass a bound on scores, and only theirs are computed in double precision.
    """

    def __init__(self, metric: str, ids: np.ndarray, points: pa.Array):
        self.metric, self.ids, self.order = metric, ids, np.argsort(ids, kind="stable")
        if metric == "jaccard":
            tokens, starts = tokens_of(points)
            self.sizes = np.diff(starts)
            owner = np.repeat(np.arange(len(ids)), self.sizes)
            distinct, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
            # tokens of many sets are columns of a matrix, the others lists of the sets that hold them
            often = np.argsort(-count, kind="stable")[: MATRIX_BYTES // (4 * max(1, len(ids)))]
            self.often = np.sort(distinct[often[count[often] * COMMON > len(ids)]])
            column = np.searchsorted(self.often, tokens)
            held = self.often[np.minimum(column, len(self.often) - 1)] == tokens if len(self.often) else np.zeros(len(tokens), bool)
            self.matrix = np.zeros((len(ids), len(self.often)), np.float32)
            self.matrix[owner[held], column[held]] = 1
            tokens, owner = tokens[~held], owner[~held]
            order = np.argsort(tokens, kind="stable")
            self.tokens, self.owner = tokens[order], owner[order]
        else:
            self.matrix = unit(matrix_of(points)) if metric == "angular" else matrix_of(points)
            self.squares = (self.matrix * self.matrix).sum(axis=1)
            with np.errstate(over="ignore"):
                self.light = self.matrix.T.astype(np.float32)

    def _common(self, points: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that each point shares with each of the block's, and the points' sizes."""
        tokens, starts = tokens_of(points)
        row = np.repeat(np.arange(len(points)), np.diff(starts))
        common = np.zeros((len(points), len(self.ids)))
        if len(self.often):
            column = np.minimum(np.searchsorted(self.often, tokens), len(self.often) - 1)
            held = self.often[column] == tokens
            some = np.zeros((len(points), len(self.often)), np.float32)
            some[row[held], column[held]] = 1
            common += some @ self.matrix.T
            tokens, row = tokens[~held], row[~held]
        low, high = np.searchsorted(self.tokens, tokens, "left"), np.searchsorted(self.tokens, tokens, "right")
        met = high > low
        low, n, row = low[met], (high - low)[met], row[met]
        ends = np.cumsum(n)
        at = 0
        while at < len(n):  # so many entries of the lists at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
            m, before = n[at:to], ends[at:to] - n[at:to]
            entry = np.repeat(low[at:to] - before, m) + np.arange(before[0], ends[to - 1])
            first, last = row[at], row[to - 1] + 1
            cell = np.repeat(row[at:to] - first, m) * len(self.ids) + self.owner[entry]
            common[first:last] += np.bincount(cell, minlength=(last - first) * len(self.ids)).reshape(last - first, len(self.ids))
            at = to
        return common, np.diff(starts)

    def scores(self, points: pa.Array):
        """Scores with a row for each point and a column for each of the block's, their margin, and the similarities of rows and columns."""
        if self.metric == "jaccard":
            common, sizes = self._common(points)
            union = sizes[:, None] + self.sizes[None, :] - common
            sims = np.divide(common, union, out=common, where=union > 0)
            return sims, 0.0, lambda row, col: sims[row, col]
        x = matrix_of(points)
        if not x.size or not self.matrix.size:
            return np.zeros((len(points), len(self.ids)), np.float32), 1.0, lambda row, col: np.zeros(len(row))
        if x.shape[1] != self.matrix.shape[1]:
            raise ValueError("vectors must be of one length and hold no nulls")
        x = unit(x) if self.metric == "angular" else x
        squares = (x * x).sum(axis=1)
        large = max(float(squares.max()), float(self.squares.max())) > 1e30  # beyond single precision
        scores = x @ self.matrix.T if large else x.astype(np.float32) @ self.light
        margin = 1e-6 * x.shape[1] * max(1e-30, float(squares.max()), float(self.squares.max()))
        if self.metric == "l2":  # half the squared distance, below zero
            scores -= (squares / 2).astype(scores.dtype)[:, None]
            scores -= (self.squares / 2).astype(scores.dtype)[None, :]
        exact = self._cosines if self.metric == "angular" else self._distances

        def similar(row: np.ndarray, col: np.ndarray) -> np.ndarray:
            parts = [exact(x[row[i : i + 16_384]], self.matrix[col[i : i + 16_384]]) for i in range(0, len(row), 16_384)]
            return np.concatenate(parts) if parts else np.zeros(0)

        return scores, margin, similar

    @staticmethod
    def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.clip((np.einsum("ij,ij->i", a, b) + 1) / 2, 0, 1)

    @staticmethod
    def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.einsum("ij,ij->i", a - b, a - b))

    def least_score(self, s: np.ndarray) -> np.ndarray:
        """The score of similarity s; of 0 one that all have."""
        s = np.asarray(s, dtype=np.float64)
        with np.errstate(divide="ignore"):
            score = s if self.metric == "jaccard" else 2 * s - 1 if self.metric == "angular" else -(1 / s - 1) / 2
        return np.where(s > 0, score, -np.inf)

    def similarities(self, points: pa.Array) -> np.ndarray:
        """A row for each point and a column for each of the block's."""
        scores, _, similar = self.scores(points)
        row, col = np.divmod(np.arange(scores.size), max(1, scores.shape[1]))
        return similar(row, col).reshape(scores.shape)

    def without(self, scores: np.ndarray, ids: np.ndarray, lower: bool = False) -> None:
        """Take pairs of one id out of the scores; with lower also those whose id in the block is the lower one."""
        known = self.ids[self.order]
        low, high = np.searchsorted(known, ids, "left"), np.searchsorted(known, ids, "right")
        for r in np.flatnonzero(high > (0 if lower else low)):
            scores[r, self.order[0 if lower else low[r] : high[r]]] = -np.inf


def best(query: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Rows that are among their query's k best by similarity, then id, both descending."""
    order = np.lexsort((-ids, -sims, query))
    q = query[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def _task_knn(block: Block, k: int, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        n = len(block.ids)
        floor = np.full(n, -np.inf)  # the least score that may be among a query's k best
        step = max(1, CELLS // max(1, n, block.matrix.shape[1]))

        def kept() -> None:
            """Only the k best found of each query stay."""
            nonlocal found
            q, p, s = (np.concatenate(x) for x in zip(*found, strict=True))
            top = best(q, p, s, k)
            found = [(q[top], p[top], s[top])]
            full = np.bincount(q[top], minlength=n) >= k
            least = np.full(n, np.inf)
            np.minimum.at(least, q[top], s[top])
            floor[full] = block.least_score(least[full])

        new = 0
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                scores, margin, similar = block.scores(part.column(1))
                if exclude_self:
                    block.without(scores, ids)
                cut = floor
                if len(ids) > k and np.isneginf(floor).any():
                    cut = np.maximum(floor, np.partition(scores, len(ids) - k, axis=0)[len(ids) - k])
                row, col = np.nonzero((scores >= (cut - 2 * margin)[None, :]) & (scores > -np.inf))
                sims = similar(row, col)
                some = sims > 0
                found.append((col[some], ids[row[some]], sims[some]))
                new += int(some.sum())
                if new > max(k * n // 2, 50_000) or np.isneginf(floor).any():
                    kept()
                    new = 0
        kept()
        q, p, s = found[0]
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(p), pa.array(s)], names=["query_id", "id", "similarity"])

    return run


def measured(points: DataFrame, column: str, metric: str) -> tuple[DataFrame, int, int]:
    """points without nulls, their number, and their elements as 8-byte numbers; vectors are checked to be of one length."""
    if metric == "jaccard":
        points = points.withColumn(column, F.array_compact(column))
    hollow = F.max(F.exists(column, lambda x: x.isNull())) if metric != "jaccard" else F.lit(False)
    n, total, low, high, nulls = points.agg(F.count("*"), F.sum(F.size(column).cast("long")), F.min(F.size(column)), F.max(F.size(column)), hollow).first()
    if metric != "jaccard" and (low != high or nulls):
        raise ValueError("vectors must be of one length and hold no nulls")
    return points, n, 8 * (total or 0)


def top_k(rows: DataFrame, k: int, by: str = "query_id", item: str = "id") -> DataFrame:
    """The k best rows of each query with their rank from 1."""
    w = Window.partitionBy(by).orderBy(F.desc("similarity"), F.desc(item))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(points: DataFrame, queries: DataFrame, k: int, metric: str = "angular", column: str = "features", exclude_self: bool = False) -> DataFrame:
    """query_id, id, similarity, rank: the k most similar points (id, column) of each query (query_id, column)."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    spark, schema = points.sparkSession, "query_id long, id long, similarity double"
    light = points.select(F.col("id").cast("long"), column).where(F.col(column).isNotNull() & F.col("id").isNotNull())
    if metric == "jaccard":
        light = light.withColumn(column, F.array_compact(column))
    asked, n, size = measured(queries.select(F.col("query_id").cast("long"), column).where(F.col(column).isNotNull()), column, metric)
    blocks = max(1, -(-size // QUERY_BYTES)) if n else 0
    found = None
    for b in range(blocks if k > 0 else 0):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id", F.lit("block")), F.lit(blocks)) == b)
        rows = some.toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        points_of = rows.column(1)
        block = Block(metric, rows.column(0).to_numpy().astype(np.int64), points_of.chunk(0) if isinstance(points_of, pa.ChunkedArray) else points_of)
        shared = spark.sparkContext.broadcast(block)
        part = light.mapInArrow(lambda it, shared=shared: _task_knn(shared.value, k, exclude_self)(it), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema + ", rank int")
    return top_k(found, k)


def _by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one pair of blocks at a time, from batches sorted by pair."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        pairs = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(pairs)) + 1).tolist(), len(pairs)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi == lo:
                continue
            if rest and rest[0].column(0)[0].as_py() != pairs[lo]:
                yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
                rest = []
            rest.append(batch.slice(lo, hi - lo))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def _task_pairs(metric: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for part in _by_pair(batches):
            side, ids, points = part.column(1).to_numpy(), part.column(2).to_numpy(), part.column(3)
            n = int((side == 0).sum())
            within = n == len(ids)
            left, right = ids[:n], ids if within else ids[n:]
            block = Block(metric, right, points if within else pa.concat_arrays([points.slice(n)]))
            step = max(1, CELLS // max(len(right), block.matrix.shape[1]))
            for at in range(0, n, step):
                some = left[at : at + step]
                scores, margin, similar = block.scores(pa.concat_arrays([points.slice(at, len(some))]))
                block.without(scores, some, lower=within)
                cut = float(block.least_score(held[2].min())) if len(held[2]) >= k else -np.inf
                if cut == -np.inf and scores.size > k:
                    cut = np.partition(scores, scores.size - k, axis=None)[scores.size - k]
                row, col = np.nonzero((scores >= cut - 2 * margin) & (scores > -np.inf))
                s = similar(row, col)
                row, col, s = row[s > 0], col[s > 0], s[s > 0]
                a, b = np.minimum(some[row], right[col]), np.maximum(some[row], right[col])
                a, b, s = np.concatenate([held[0], a]), np.concatenate([held[1], b]), np.concatenate([held[2], s])
                order = np.lexsort((-b, -a, -s))[: 2 * k]
                a, b, s = a[order], b[order], s[order]
                # a pair may come from several groups, so once from those held and once from this one
                _, first = np.unique(np.stack([a, b]), axis=1, return_index=True)
                top = np.sort(first)[:k]
                held = (a[top], b[top], s[top])
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["id_a", "id_b", "similarity"])

    return run


def highest_of_equal(points: DataFrame, k: int, column: str) -> DataFrame:
    """Of points that are equal, the k + 1 of highest id: no other can be in a pair among the k best."""
    w = Window.partitionBy(F.xxhash64(column), column).orderBy(F.desc("id"))
    return points.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k + 1).drop("__n")


def best_pairs(rows: DataFrame, k: int) -> DataFrame:
    """The k best distinct pairs by similarity, then ids, all descending, with rank; tasks may have found a pair several times."""
    each = rows.groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))
    top = each.orderBy(F.desc("similarity"), F.desc("id_a"), F.desc("id_b")).limit(k)
    w = Window.orderBy(F.desc("similarity"), F.desc("id_a"), F.desc("id_b"))
    return top.withColumn("rank", F.row_number().over(w))


def pair_block(n: int, size: int, cores: int) -> int:
    """Points in a block: PAIR_BYTES of them, or fewer so that all cores have several pairs of blocks to compare."""
    most = max(1_024, PAIR_BYTES * n // max(1, size))
    return max(256, min(most, -(-n // max(1, int((8 * cores) ** 0.5)))))


def equal_pairs(sets: DataFrame, k: int) -> DataFrame:
    """The k best pairs of equal sets (id, point) that are not empty: their similarity is 1, which no other pair has."""
    same = sets.where(F.size("point") > 0).groupBy(F.xxhash64("point"), "point").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    each = same.select(F.posexplode("ids").alias("at", "id_a"), "ids").select("id_a", F.explode(F.expr("slice(ids, at + 2, size(ids))")).alias("id_b")).where("id_a < id_b")
    return best_pairs(each.withColumn("similarity", F.lit(1.0)), k)


def closest_pairs(points: DataFrame, k: int, metric: str = "angular", column: str = "features", block: int | None = None) -> DataFrame:
    """id_a < id_b, similarity, rank: the k most similar pairs of points (id, column).

    Where k pairs of equal sets exist they are the result, and no two sets need to be compared.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    spark = points.sparkSession
    if k <= 0:
        return spark.createDataFrame([], "id_a long, id_b long, similarity double, rank int")
    light = points.select(F.col("id").cast("long"), F.col(column).alias("point")).where("id is not null and point is not null")
    if metric == "jaccard":
        light = light.withColumn("point", F.array_sort(F.array_distinct(F.array_compact("point"))))
    light = highest_of_equal(light, k, "point")
    if metric == "jaccard":
        light = persist_table(light, "pairs-sets")
        equal = equal_pairs(light, k)
        if equal.count() >= k:
            return equal
    light, n, size = measured(light, "point", metric)
    block = block or pair_block(n, size, spark.sparkContext.defaultParallelism)
    blocks = max(1, -(-n // block))
    dealt = light.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    tasks = dealt.select(
        (F.least("own", "other") * blocks + F.greatest("own", "other")).alias("pair"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "point"
    )
    # a stated number, as Spark would put pairs of few bytes but much work into one task
    parts = min(PAIR_TASKS, blocks * (blocks + 1) // 2)
    found = tasks.repartition(parts, "pair").sortWithinPartitions("pair", "side", "id").mapInArrow(_task_pairs(metric, k), "id_a long, id_b long, similarity double")
    return best_pairs(found, k)
