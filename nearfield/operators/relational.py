"""Hash families as pure relations, with MD5-derived constants that another engine can reproduce.

These run inside generated code, MinHash over Arrow batches, and are bit-identical wherever MD5 and integer sums are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.formats import to_q15

#: Tokens whose hashes a task remembers.
TOKENS = 200_000


def md5_int(key: Column) -> Column:
    """The first 32 bits of a string's MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def coordinates(points: DataFrame, id_col: str, column: str) -> DataFrame:
    """id, dim, code: the 16-bit codes of vectors as rows."""
    return points.select(F.col(id_col).alias("id"), F.posexplode(column).alias("dim", "value")).select("id", "dim", to_q15(F.col("value")).cast("long").alias("code"))


def sign_planes(spark: SparkSession, tables: int, bits: int, dimensions: int, seed: int = 42) -> DataFrame:
    """table_id, bit, dim, sign: hyperplanes of signs; tables * bits * dimensions rows."""
    n = spark.range(tables * bits * dimensions)
    at = n.select((F.col("id") / (bits * dimensions)).cast("int").alias("table_id"), F.pmod((F.col("id") / dimensions).cast("int"), F.lit(bits)).alias("bit"), F.pmod("id", F.lit(dimensions)).cast("int").alias("dim"))
    key = F.concat_ws(":", F.lit(str(seed)), "table_id", "bit", "dim")
    return at.withColumn("sign", 1 - 2 * F.pmod(md5_int(key), F.lit(2)))


def simhash_tables(points: DataFrame, tables: int, bits: int, dimensions: int, id_col: str = "id", column: str = "features", seed: int = 42) -> DataFrame:
    """table_id, id, hash: the sides of bits hyperplanes, the first one highest."""
    planes = F.broadcast(sign_planes(points.sparkSession, tables, bits, dimensions, seed))
    sums = coordinates(points, id_col, column).join(planes, "dim").groupBy("table_id", "id", "bit").agg(F.sum(F.col("code") * F.col("sign")).alias("total"))
    one = F.when(F.col("total") >= 0, F.expr(f"shiftleft(1, {bits - 1} - bit)")).otherwise(0)
    return sums.groupBy("table_id", "id").agg(F.sum(one).cast("int").alias("hash"))


def minhash_tables(sets: DataFrame, tables: int, id_col: str = "id", column: str = "tokens", seed: int = 42) -> DataFrame:
    """table_id, id, token (of smallest hash, then smallest), hash.

    Sets are hashed where they are, a token about once in a task; a row for each set and table is shuffled, as an id may have several sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            full = np.flatnonzero(sizes)
            if not len(full):
                continue
            distinct, place = np.unique(flat.to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
            if len(known) > TOKENS:
                known.clear()
            for t in distinct.tolist():
                if t not in known:
                    # hash (32 bits) and token (31 bits) in one number
                    known[t] = [int(hashlib.md5(f"{seed}:{i}:{t}".encode(), usedforsecurity=False).hexdigest()[:8], 16) << 31 | t for i in range(tables)]
            keys = np.array([known[t] for t in distinct.tolist()], dtype=np.int64)
            starts = (np.cumsum(sizes) - sizes)[full]
            ids = batch.column(0).take(pa.array(full))
            for i in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), i, np.int32)), ids, pa.array(np.minimum.reduceat(keys[:, i][place], starts))], names=["table_id", "id", "key"])

    sets = sets.select(F.col(id_col).alias("id"), F.array_compact(column).alias(column)).where(F.col(column).isNotNull())
    least = sets.mapInArrow(run, f"table_id int, id {sets.schema['id'].dataType.simpleString()}, key long").groupBy("table_id", "id").agg(F.min("key").alias("key"))
    return least.select("table_id", "id", F.col("key").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("token"), F.shiftright("key", 31).alias("hash"))


def tabulation_hash(token: Column, seed: int = 42) -> Column:
    """Exclusive or of one 32-bit table entry for each of a token's four bytes."""
    out = None
    for i in range(4):
        byte = F.shiftright(token.cast("long"), 8 * i).bitwiseAND(F.lit(255))
        entry = md5_int(F.concat(F.lit(f"{seed}:{i}:"), byte.cast("string")))
        out = entry if out is None else out.bitwiseXOR(entry)
    return out


def hadamard_rows(coords: DataFrame, size: int, by: str = "id", at: str = "dim", value: str = "code") -> DataFrame:
    """id, axis, total: the unnormalised Hadamard transform of sparse integer rows, size a power of two."""
    axes = coords.withColumn("axis", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    sign = 1 - 2 * F.pmod(F.bit_count(F.col(at).bitwiseAND(F.col("axis"))), F.lit(2))
    return axes.groupBy(by, "axis").agg(F.sum(F.col(value) * sign).alias("total"))


def closest_axes(totals: DataFrame, size: int, by: str = "id") -> DataFrame:
    """id, hash: the axis of largest absolute total, the first of equal ones; size is added where it is negative."""
    top = totals.groupBy(by).agg(F.max(F.struct(F.abs("total").alias("far"), (-F.col("axis")).alias("first"), "total")).alias("top"))
    return top.select(by, (-F.col("top.first") + F.when(F.col("top.total") < 0, size).otherwise(0)).alias("hash"))
