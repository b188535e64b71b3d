import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def spark():
    from promptlake.session import local_session

    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = local_session(os.environ.get("TEST_CORES", "8"), **{"spark.local.dir": scratch, "spark.sql.warehouse.dir": f"{scratch}/warehouse", "spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    """A value that can be compared: floats rounded, rows and maps as tuples."""
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6)
    if isinstance(value, dict) or hasattr(value, "asDict"):
        items = value.items() if isinstance(value, dict) else value.asDict().items()
        return tuple((k, plain(v)) for k, v in items)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.fixture(scope="session")
def same_rows():
    """Fails unless a DataFrame and a DuckDB relation hold the same columns and rows, in any order."""

    def check(df, found):
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names)
        ours = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect())
        at = [names.index(c) for c in sorted(names)]
        theirs = sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
        assert ours == theirs

    return check
