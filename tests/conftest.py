import pandas as pd
import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    found = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    found.sparkContext.setLogLevel("ERROR")
    return found


DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return round(x, 9)
    return x


def same_as_sql(spark, query, sql):
    """Whether a query and its SQL give the same rows on the smallest tables."""
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for name in TABLES:
        c.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    a, b = query(spark, DATA).toPandas(), c.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda d: sorted((tuple(map(plain, r)) for r in d[sorted(d.columns)].itertuples(index=False)), key=repr)
    assert rows(a) == rows(b)
    assert len(a)
