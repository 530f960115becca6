import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.driver.memory", "6g").getOrCreate()
    )
    yield s
    s.stop()


@pytest.fixture(scope="session")
def oracle():
    """run(sql, sf_dir) -> rows as a data frame, by DuckDB over the same files."""
    import duckdb

    def run(sql: str, sf_dir: str):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
        return con.execute(sql).fetchdf()

    return run


@pytest.fixture(scope="session")
def same():
    """Compare two data frames as multisets of rows, columns by name."""

    def check(got, want):
        assert sorted(got.columns) == sorted(want.columns)
        cols = sorted(got.columns)

        def rows(d):
            return sorted(tuple("" if x is None or x != x else repr(round(float(x), 6)) if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind in "fiu" else str(x) for x in r) for r in d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False))

        a, b = rows(got), rows(want)
        a, b = [[_num(x) for x in r] for r in a], [[_num(x) for x in r] for r in b]
        assert sorted(a) == sorted(b)

    def _num(x):
        try:
            return repr(round(float(x), 6) + 0.0)
        except ValueError:
            return x

    return check
