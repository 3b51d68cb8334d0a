import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(base / "shared")).config("spark.local.dir", str(base / "local")).config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Hold a query against its SQL on the smallest tables."""
    import math

    def norm(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    def check(query, sql):
        df = query(spark, SF)
        columns = sorted(df.columns)
        mine = sorted([tuple(norm(r[c]) for c in columns) for r in df.collect()], key=str)
        found = duck.sql(sql)
        names = list(found.columns)
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        theirs = sorted([tuple(norm(r[i]) for i in at) for r in found.fetchall()], key=str)
        assert mine == theirs

    return check
