import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cpgloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="8", shuffle_partitions=4, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def cells(spark):
    """Three probes by four samples with gaps, ages by sample."""
    rows = [
        (p, f"s{i}", b)
        for p, line in enumerate([[0.1, None, 0.3, 0.4], [0.5, 0.6, None, None], [0.2, 0.2, 0.2, 0.2]])
        for i, b in enumerate(line)
    ]
    return spark.createDataFrame(rows, "probe_ord BIGINT, sample_id STRING, beta DOUBLE")
