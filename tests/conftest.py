"""One Spark session for all tests, and DuckDB over the same tables."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from passagemill.session import local_session

    s = local_session(4, 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _cell(x):
    if x is None or isinstance(x, float) and x != x:
        return "NULL"
    return repr(round(x, 9)) if isinstance(x, float) else str(x)


@pytest.fixture(scope="session")
def same_rows():
    """Whether a DataFrame and a DuckDB result hold the same rows, by column name."""

    def check(df, result):
        cols = sorted(df.columns)
        names = [d[0] for d in result.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        ours = sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())
        theirs = sorted(tuple(_cell(r[i]) for i in at) for r in result.fetchall())
        assert ours == theirs
        return len(ours)

    return check
