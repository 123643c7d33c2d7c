import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = Path(os.environ.get("SHARDLOOM_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoint')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    """The smallest tables."""
    d = DATA / "sf0.001"
    if not d.is_dir():
        pytest.skip("no test tables")
    return str(d)


@pytest.fixture(scope="session")
def same_as_duckdb(spark, sf):
    """Compare a query with its SQL, rows as sorted lists, doubles to 9 digits."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")

    def plain(v):
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    def check(query, sql):
        df = query(spark, sf)
        cols = sorted(df.columns)
        got = sorted(tuple(plain(v) for v in r) for r in df.select(cols).collect())
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())

    return check
