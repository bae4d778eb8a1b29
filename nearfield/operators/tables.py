"""Hashes of points for all tables, tables as rows (table_id, hash, id), prefix joins over them, and sketch filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.numbers import Numbers

from .exact import matrix_of, tokens_of, unit
from .families import Sets
from .hash_sources import DEPTH, Source
from .probing import ranged_candidates, ranged_counts  # noqa: F401

#: Sketches of a point, and bits of a sketch.
SKETCHES = 32
SKETCH_BITS = 64


class Hasher:
    """Table hashes and sketches of a batch of points."""

    def __init__(self, source: Source, sketch_family, space: int, seed: int, sketches: int = SKETCHES):
        self.source, self.metric = source, source.family.metric
        self.sketches = sketches
        self.sketch = sketch_family(sketches * SKETCH_BITS, space, Numbers(seed, 2)) if sketches else None

    def batch(self, points: pa.Array) -> np.ndarray | Sets:
        return Sets(*tokens_of(points)) if self.metric == "jaccard" else unit(matrix_of(points))

    def hashes_of(self, points: pa.Array) -> np.ndarray:
        return self.source.hash(self.batch(points))

    def sketches_of(self, points: pa.Array) -> np.ndarray:
        bits = self.sketch.hash(self.batch(points)).astype(np.uint8).reshape(len(points), self.sketches, SKETCH_BITS)
        return np.packbits(bits, axis=2).reshape(len(points), self.sketches, 8).view(">i8")[..., 0].astype(np.int64)


def _with_lists(points: DataFrame, numbers_of, name: str, kind: pa.DataType, batch_rows: int) -> DataFrame:
    """points, of which the second column is the point, with a list of numbers for each point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                m = numbers_of(pa.concat_arrays([part.column(1)]))
                row = pa.FixedSizeListArray.from_arrays(pa.array(m.ravel(), kind), m.shape[1]).cast(pa.list_(kind)) if m.shape[1] else pa.array([[]] * len(m), pa.list_(kind))
                yield pa.RecordBatch.from_arrays([*part.columns, row], names=[*part.schema.names, name])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(run, f"{fields}, {name} array<{'int' if kind == pa.int32() else 'long'}>")


def hashed(points: DataFrame, hasher: Hasher, column: str, batch_rows: int = 512) -> DataFrame:
    """points (id, column) with hashes, one for each table, in one pass and without a shuffle."""
    shared = points.sparkSession.sparkContext.broadcast(hasher)
    light = points.select(F.col("id").cast("long"), column).where(F.col(column).isNotNull() & F.col("id").isNotNull())
    return _with_lists(light, lambda x: shared.value.hashes_of(x), "hashes", pa.int32(), batch_rows)


def sketched(points: DataFrame, hasher: Hasher, batch_rows: int = 512) -> DataFrame:
    """points (id, a column of points, and others) with sketches, which only filters need."""
    shared = points.sparkSession.sparkContext.broadcast(hasher)
    return _with_lists(points, lambda x: shared.value.sketches_of(x), "sketches", pa.int64(), batch_rows)


def table_rows(points: DataFrame) -> DataFrame:
    """(table_id, hash, id) of points with hashes."""
    return points.select("id", F.posexplode("hashes").alias("table_id", "hash")).select("table_id", "hash", "id")


def prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, DEPTH - depth)


def prefix_candidates(queries: DataFrame, tables: DataFrame, depth: int) -> DataFrame:
    """(query_id, id, table_id): points that share a table's prefix of so many bits with a query (query_id, table_id, hash)."""
    q = queries.select("query_id", F.col("table_id").alias("t"), prefix(F.col("hash"), depth).alias("p"))
    return tables.join(q, (F.col("table_id") == F.col("t")) & (prefix(F.col("hash"), depth) == F.col("p"))).select("query_id", "id", "table_id")


#: Leading bits whose counts the directory holds.
DIRECTORY_BITS = 16


def directory(tables: DataFrame) -> DataFrame:
    """(table_id, cell, size): rows of the tables by their leading bits."""
    return tables.groupBy("table_id", prefix(F.col("hash"), DIRECTORY_BITS).alias("cell")).agg(F.count("*").alias("size"))


def bucket_sizes(tables: DataFrame, depth: int) -> DataFrame:
    """(table_id, prefix, size)."""
    return tables.groupBy("table_id", prefix(F.col("hash"), depth).alias("prefix")).agg(F.count("*").alias("size"))


def sketch_passes(a: Column, b: Column, threshold: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= threshold
