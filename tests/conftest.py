import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture
def splitting(spark):
    """Force the hot-key path of ordered scans on small inputs."""
    from ledgerloom.operators import ordered

    spark.conf.set(ordered.MIN_BYTES, "0")
    spark.conf.set(ordered.MIN_ROWS, "3")
    yield spark
    spark.conf.unset(ordered.MIN_BYTES)
    spark.conf.unset(ordered.MIN_ROWS)
