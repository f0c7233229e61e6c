import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TESTDATA = Path(os.environ.get("TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from quire.session import ship

    ship(s)
    return s


@pytest.fixture(scope="session")
def sf_dir():
    return str(TESTDATA / "sf0.001")


def normal(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(normal(v) for v in r) for r in df.select(*cols).collect()), key=repr)


def duck_rows(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{f}')")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(normal(x[i]) for i in order) for x in r.fetchall()), key=repr)
