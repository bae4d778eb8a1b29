"""Every query with SQL gives the SQL's rows."""

import pytest

from nearfield.plans import catalog, searches  # noqa: F401  searches registers its queries

from .conftest import rows_of

#: These build many indexes or compare many sets; tests/test_index.py covers the same paths on less.
SLOW = {"recall_by_setting", "knn_lsh_jaccard", "closest_pairs_jaccard_lsh", "closest_baskets_bf"}


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - SLOW))
def test_query_matches_sql(name, spark, duck, sf_dir):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(catalog.ORACLES[name]).df()
    assert rows_of(got) == rows_of(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries)
    assert entry.entry(spark).count() == 250  # ten neighbours of each of the 25 stored points whose id is divisible by 20
