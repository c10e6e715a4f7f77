import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from folioworks.session import local_session

    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate an expression of one text."""
    from pyspark.sql import functions as F

    def run(fn, text):
        return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("r")).first()["r"]

    return run
