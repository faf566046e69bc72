import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared")), "spark.ui.showConsoleProgress": "false",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def plain(rows):
    """Rows as sorted tuples by column name, floats to 6 digits."""

    def one(v):
        if isinstance(v, float):
            return round(v, 6) + 0.0
        return [one(x) for x in v] if isinstance(v, (list, tuple)) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same(spark):
    """Holds a query against its SQL, on a folder of tables."""

    def check(query, sql, sf_dir=SF):
        con = duckdb.connect()
        for t in TABLES:
            if os.path.exists(f"{sf_dir}/{t}.parquet"):
                path = f"{sf_dir}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{t}.parquet") else "")
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
        ours = query(spark, sf_dir)
        theirs = con.sql(sql)
        names = sorted(ours.columns)
        assert names == sorted(theirs.columns)
        a = plain(tuple(r[c] for c in names) for r in ours.collect())
        b = plain(theirs.select(*(f'"{c}"' for c in names)).fetchall())
        assert len(a) == len(b) and a == b

    return check
