"""Reading and making points: word-vector text files, tables, random vectors and sets, and a log of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word, features of lines "word f1 f2 ..."; blank lines, and lines without numbers, are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(parts.alias("parts")).where(F.size("parts") > 1)
    return lines.select(F.element_at("parts", 1).alias("word"), F.slice("parts", 2, F.size("parts") - 1).cast("array<float>").alias("features"))


def write_word_vectors(points: DataFrame, path: str, word: str = "word", column: str = "features") -> None:
    points.select(F.concat_ws(" ", F.col(word), F.array_join(F.col(column).cast("array<string>"), " "))).write.text(path)


def random_vectors(spark: SparkSession, n: int, dimensions: int, seed: int = 42) -> DataFrame:
    """id, features: independent standard normal coordinates."""
    return spark.range(n).select("id", F.array(*[F.randn(seed * 1_000_003 + i).cast("float") for i in range(dimensions)]).alias("features"))


def random_sets(spark: SparkSession, n: int, universe: int, share: float = 0.3, seed: int = 42) -> DataFrame:
    """id, tokens: each token of the universe with the given chance."""
    cut = int(share * 1_000_000)
    kept = F.filter(F.sequence(F.lit(0), F.lit(universe - 1)), lambda t: F.pmod(F.xxhash64(F.col("id"), t, F.lit(seed)), F.lit(1_000_000)) < cut)
    return spark.range(n).select("id", kept.alias("tokens"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes from fewer files than there are cores, as a file's row group is one task's."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df._jdf.inputFiles()) < cores else df


def table_points(spark: SparkSession, path: str, id_col: str, column: str, name: str = "features") -> DataFrame:
    return spread(spark.read.parquet(path).select(F.col(id_col).alias("id"), F.col(column).alias(name)))


def log_measurements(rows: list[dict], spark: SparkSession, path: str) -> None:
    """Append measurements to a Parquet log."""
    spark.createDataFrame(rows).write.mode("append").parquet(path)
