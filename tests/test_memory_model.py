"""The memory model for any number of points."""

import pytest

from nearfield.operators import families, hash_sources
from nearfield.plans import catalog, searches  # noqa: F401  searches registers its queries

from .conftest import rows_of


def test_tables_for_memory_of_any_number_of_points(spark, duck, tmp_path):
    """30,000 vectors exceed 10 MB by themselves; SQL's number is then below zero, and an index still refuses."""
    spark.range(30_000).selectExpr("id as vec_id", "array(cast(1 as float)) as embedding", "0 as label").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["tables_for_memory"](spark, str(tmp_path)).toPandas()
    want = duck.sql(catalog.ORACLES["tables_for_memory"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).df()
    assert rows_of(got) == rows_of(want) and got["tables"].min() < 0
    for n in (26_000, 26_041, 26_042, 120_000, 720_000):
        each = 24 * 128 + 4 * (2**13 + 1) + 8 * 24 + 8 * n
        assert hash_sources.tables_within(10**7, n, 128, families.SimHash, 64) == -((n * 384 - 10**7) // each) - 1
    with pytest.raises(ValueError, match="insufficient"):
        hash_sources.tables_for(10**7, 30_000, 128, families.SimHash, 64)
