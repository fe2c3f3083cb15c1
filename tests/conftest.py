import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from spanweave.session import get_spark, checkpoint_dir
    s = get_spark("local[8]", app="spanweave-tests", shuffle_partitions=8,
                  extra={"spark.driver.memory": "8g"})
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def scratch():
    return tempfile.mkdtemp(prefix="spanweave-test-")
