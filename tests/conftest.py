import os
import sys
from pathlib import Path

import pytest

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from nearfield.session import local_session

    return local_session("4", 4, **{"spark.driver.memory": "6g", "spark.sql.adaptive.coalescePartitions.enabled": "true"})


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows_of(frame):
    """A pandas frame as sorted rows with columns by name."""
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v != v else v
    return sorted((tuple(clean(v) for v in r) for r in frame.itertuples(index=False)), key=repr)
