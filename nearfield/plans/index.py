"""The index: a collection of points with hash tables, searched approximately or exactly.

A point is searchable by search() once rebuild() has run after its insertion; the exact methods see every
inserted point. Inserts append; the same seed gives the same functions, so a saved index needs no function
tables, only its settings. Of queries with one id, one is asked.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import formats
from nearfield.operators import adaptive, exact, families, hash_sources, tables
from nearfield.session import persist_table, scratch_path

#: Tables where neither a number nor a memory limit is given.
DEFAULT_TABLES = 64
#: Appended segments after which a rebuild writes points and tables anew.
SEGMENTS = 16
STORAGE = ("double", "q15")


@dataclass
class IndexSpec:
    metric: str
    dimensions: int
    num_tables: int | None = None
    memory_limit: int | None = None
    hash_function: str | None = None
    hash_args: dict = field(default_factory=dict)
    hash_source: str | None = None
    source_args: dict = field(default_factory=dict)
    seed: int = 42
    sketch_function: str | None = None
    storage: str = "double"


class AnnIndex:
    """metric: "angular" or "l2" (column features) or "jaccard" (column tokens); dimensions: of vectors, or the universe of tokens.

    storage="q15" keeps unit vectors as 16-bit codes, a quarter of the bytes; similarities are then those of the
    codes. "l2" keeps vectors as they are and has no hash family: search_bf and closest_pairs_bf only.
    """

    def __init__(self, spark: SparkSession, metric: str, dimensions: int, memory_limit: int | None = None, **options):
        self.spark = spark
        self.spec = IndexSpec(metric, dimensions, memory_limit=memory_limit, **options)
        if self.spec.storage not in STORAGE or (self.spec.storage == "q15" and metric != "angular"):
            raise ValueError(f"no storage {self.spec.storage!r} for {metric}")
        if metric != "l2":
            self.family = families.family(metric, self.spec.hash_function)
            self.sketches = families.sketch_family(metric, self.spec.sketch_function)
            self.source_kind = hash_sources.source_class(self.spec.hash_source)
        self.column = "tokens" if metric == "jaccard" else "features"
        self.kind = {"tokens": "array<int>", "features": "array<short>" if self.spec.storage == "q15" else "array<double>"}[self.column]
        self.clear()
        self.metrics: list[dict] = []

    # points

    def _stored(self, value: Column) -> Column:
        """A point as it is kept: an ordered set, a vector, a unit vector, or its codes."""
        if self.column == "tokens":
            return formats.token_set(value, self.spec.dimensions).cast(self.kind)
        checked = formats.checked_vector(value, self.spec.dimensions)
        if self.spec.metric == "l2":
            return checked.cast(self.kind)
        unit = formats.normalise(checked)
        return (formats.quantise(unit) if self.spec.storage == "q15" else unit).cast(self.kind)

    def insert(self, points: DataFrame) -> AnnIndex:
        """Add points (id, features or tokens). Rows of another length, or with tokens outside the universe, are errors."""
        given = points.where(F.col("id").isNotNull() & F.col(self.column).isNotNull())
        self.staged.append(given.select(F.col("id").cast("long").alias("id"), self._stored(F.col(self.column)).alias(self.column)))
        return self

    def points(self) -> DataFrame:
        """All inserted points as stored: id and the vector, its codes, or the ordered token set."""
        parts = [x.select("id", self.column) for x in self.segments] + self.staged
        return _union(parts) if parts else self.spark.createDataFrame([], f"id long, {self.column} {self.kind}")

    def get(self, *ids: int) -> DataFrame:
        return self.points().where(F.col("id").isin(*ids))

    def count(self) -> int:
        return self.points().count()

    def get_repetitions(self) -> int:
        """Number of hash tables; 0 before the first rebuild."""
        return self.tables_used

    def clear(self) -> AnnIndex:
        self.segments: list[DataFrame] = []  # points with their hashes
        self.sketched: list[DataFrame] = []  # the first ones with sketches, as far as a filter has asked for them
        self.staged: list[DataFrame] = []
        self.tables_used = self.made_for = self.built_count = 0
        self.source: hash_sources.Source | None = None
        return self

    @property
    def built(self) -> DataFrame | None:
        """Searchable points with their hashes and sketches."""
        return tables.sketched(_union(self.segments), self._hasher(tables.SKETCHES)) if self.segments else None

    def _sketched(self) -> DataFrame:
        """The same, written once."""
        for segment in self.segments[len(self.sketched) :]:
            self.sketched.append(persist_table(tables.sketched(segment, self._hasher(tables.SKETCHES)), "index-sketched"))
        return _union(self.sketched)

    @property
    def tables(self) -> DataFrame | None:
        return tables.table_rows(_union(self.segments)).where(F.col("table_id") < self.tables_used) if self.segments else None

    def directory(self) -> DataFrame:
        """(table_id, cell, size): rows of the tables by their leading bits."""
        return tables.directory(self.tables)

    # building

    def _choose_tables(self, n: int) -> int:
        if self.spec.num_tables:
            return self.spec.num_tables
        if not self.spec.memory_limit:
            return DEFAULT_TABLES
        size = 2 * formats.padded_dimensions(self.spec.dimensions) if self.column == "features" else 24 + 4 * 32
        return hash_sources.tables_for(self.spec.memory_limit, n, size, self.family, self.spec.dimensions, self.source_kind, **self.spec.source_args)

    def _source(self, n: int) -> hash_sources.Source:
        return self.source_kind(self.family, self.spec.dimensions, n, self.spec.seed, self.spec.hash_args, **self.spec.source_args)

    def _hasher(self, sketches: int = 0) -> tables.Hasher:
        return tables.Hasher(self.source, self.sketches, self.spec.dimensions, self.spec.seed, sketches)

    def rebuild(self) -> AnnIndex:
        """Make all inserted points searchable; only points that are new since the last rebuild are hashed and written.

        They become a segment of their own; when there are SEGMENTS, all are written anew as one.
        """
        if not self.staged or self.spec.metric == "l2":
            return self
        new = _union(self.staged)
        if self.spec.memory_limit and not self.spec.num_tables:  # only then the number of points decides about the tables
            new = persist_table(new, "index-new")
            wanted = self._choose_tables(self.built_count + new.count())
        else:
            wanted = self._choose_tables(0)
        if self.tables_used and wanted < self.tables_used and self.source_kind is hash_sources.Independent:
            # the budget holds fewer tables now: the first ones stay, as their functions do
            self.tables_used = wanted
        if not self.tables_used:
            self.tables_used = self.made_for = wanted
        self.source = self.source or self._source(self.made_for)
        # points and their hashes for all tables are one table, of which each reader takes its columns
        segment = persist_table(tables.hashed(new, self._hasher(), self.column).select("id", self.column, "hashes"), "index-hashed")
        self.built_count += segment.count()
        self.segments.append(segment)
        if len(self.segments) >= SEGMENTS:
            self.segments, self.sketched = [persist_table(_union(self.segments), "index-hashed")], []
        self.staged = []
        return self

    # searching

    def _asked(self, queries: DataFrame) -> DataFrame:
        return queries.where(F.col(self.column).isNotNull()).select(F.col("query_id").cast("long"), self._stored(F.col(self.column)).alias(self.column))

    def _searchable(self, filter_type: str) -> None:
        if filter_type not in adaptive.FILTERS:
            raise ValueError(f"unknown filter type {filter_type!r}")
        if self.spec.metric == "l2":
            raise ValueError("l2 has no hash family; use the exact methods")

    def search(self, queries: DataFrame, k: int, recall: float, filter_type: str = "default", exclude_self: bool = False) -> DataFrame:
        """query_id, id, similarity, rank of the k nearest of each query (query_id, features or tokens)."""
        self._searchable(filter_type)
        asked = self._asked(queries)
        if not self.segments:
            return exact.knn(self.points().limit(0), asked, k, self.spec.metric, self.column)
        asked = tables.hashed(asked.withColumnRenamed("query_id", "id"), self._hasher(), self.column)
        if filter_type != "none":
            asked = tables.sketched(asked.select("id", self.column, "hashes"), self._hasher(tables.SKETCHES))
        asked = asked.withColumnRenamed("id", "query_id").dropDuplicates(["query_id"])
        self.source.tables = self.tables_used
        collision = self.sketches.collision(self.spec.dimensions)
        return adaptive.search(
            _union(self.segments), self._sketched, self.built_count, asked, self.source, collision, k, recall, self.spec.metric, self.column, filter_type, exclude_self, self.metrics, self.spec.storage
        )

    def query_metrics(self) -> DataFrame:
        """A row for each round of the searches since the last clear_metrics(): depth, candidates, queries, finished, seconds."""
        return self.spark.createDataFrame([tuple(r[c] for c in ("depth", "candidates", "queries", "finished", "seconds")) for r in self.metrics], "depth int, candidates long, queries long, finished long, seconds double")

    def clear_metrics(self) -> None:
        self.metrics = []

    def search_from_index(self, ids: DataFrame, k: int, recall: float, filter_type: str = "default") -> DataFrame:
        """The same for stored points (column id), which are not their own neighbours."""
        asked = self.points().join(ids.select("id").distinct(), "id", "left_semi").withColumnRenamed("id", "query_id")
        return self.search(asked, k, recall, filter_type, exclude_self=True)

    def search_bf(self, queries: DataFrame, k: int) -> DataFrame:
        return exact.knn(self.points(), self._asked(queries), k, self.spec.metric, self.column)

    def closest_pairs(self, k: int, recall: float, filter_type: str = "default") -> DataFrame:
        """id_a, id_b, similarity, rank; the filter type is accepted and, as pairs use no sketches, not used."""
        self._searchable(filter_type)
        if not self.segments:
            return exact.closest_pairs(self.points().limit(0), k, self.spec.metric, self.column)
        self.source.tables = self.tables_used
        return adaptive.closest_pairs(_union(self.segments), self.source, k, recall, self.spec.metric, self.column, self.metrics)

    def closest_pairs_bf(self, k: int) -> DataFrame:
        return exact.closest_pairs(self.points(), k, self.spec.metric, self.column)

    # persistence

    def save(self, path: str) -> None:
        """Write settings and points with their hashes, which are the tables, below path."""
        meta = asdict(self.spec) | {"tables_used": self.tables_used, "made_for": self.made_for}
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        if self.segments:
            _union(self.segments).write.mode("overwrite").parquet(f"{path}/points")
        for i, part in enumerate(self.staged):
            part.write.mode("overwrite" if not i else "append").parquet(f"{path}/staged")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AnnIndex:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
        used, made = meta.pop("tables_used"), meta.pop("made_for")
        index = cls(spark, meta.pop("metric"), meta.pop("dimensions"), meta.pop("memory_limit"), **meta)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        have = {f.getPath().getName() for f in files.listStatus(folder)}
        if "points" in have:
            index.tables_used, index.made_for = used, made
            index.source = index._source(made)
            points = spark.read.parquet(f"{path}/points")
            if "hashes" not in points.columns:  # saved when tables were written by themselves
                points = persist_table(tables.hashed(points, index._hasher(), index.column).select("id", index.column, "hashes"), "index-hashed")
            index.segments = [points]
            index.built_count = points.count()
        if "staged" in have:
            index.staged = [spark.read.parquet(f"{path}/staged")]
        return index


    def __reduce__(self):
        """Pickled as the path of a copy in the shared folder; unpickling loads it with the active session."""
        path = scratch_path(self.spark, "pickled-index")
        self.save(path)
        return _loaded, (path,)


def _loaded(path: str) -> AnnIndex:
    return AnnIndex.load(SparkSession.active(), path)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
