import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cladeflow.runtime import get_spark

    s = get_spark(cpus=4, shuffle_partitions=4, memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return SMALL


@pytest.fixture(scope="session")
def compare(spark, small):
    """Compares a query with its SQL on the smallest tables."""
    import glob

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")

    def rows(df):
        df = df[sorted(df.columns)]
        shown = lambda x: "~" if x is None or x != x else repr(round(float(x), 8) + 0.0) if isinstance(x, float) else str(x)
        return sorted(tuple(map(shown, r)) for r in df.itertuples(index=False))

    def run(query, sql):
        got, want = query(spark, small).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

    return run
