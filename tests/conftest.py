import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from postlake.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column over a single row and return its value."""

    def run(column, schema="x int", row=(1,)):
        return spark.createDataFrame([row], schema).select(column.alias("v")).first().v

    return run


@pytest.fixture
def pages(spark):
    def make(*htmls):
        return spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")

    return make
