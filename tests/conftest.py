import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled",
        "false").config("spark.driver.memory", "4g")
         .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir",
         str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(values, columns):
    """Comparable rows: columns by name, floats to six places."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    from decimal import Decimal

    def one(v):
        return round(float(v), 6) if isinstance(v, (float, Decimal)) else v

    return sorted((tuple(one(r[k]) for k in order) for r in values), key=repr)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
