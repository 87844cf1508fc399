import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark():
    from corpuskit.session import local_session

    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def one(spark):
    """Value of a column expression over one row."""

    def run(make, *values):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([tuple(values) or (None,)], ", ".join(f"c{i} string" for i in range(max(1, len(values)))))
        return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("v")).first()["v"]

    return run
