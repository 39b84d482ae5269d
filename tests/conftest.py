import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quillstone.session import local_session

    s = local_session("4", "tests", "4g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.fixture(scope="session")
def same():
    """Rows of a Spark and a DuckDB result as equal multisets."""

    def check(spark_df, relation):
        a, b = spark_df.toPandas(), relation.df()
        assert set(a.columns) == set(b.columns)
        cols = sorted(a.columns)
        a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
        assert len(a) == len(b)
        for c in cols:
            ok = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
            assert ok.all(), (c, a[c][~ok].head(3).tolist(), b[c][~ok].head(3).tolist())

    return check
