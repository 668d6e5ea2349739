import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from duelframe.session import build_session

    s = build_session("local[4]", shuffle_partitions=8, app_name="duelframe-tests",
                      extra={"spark.driver.memory": "4g"})
    # tests run locally: the checkpoint folder is unset, so set a fresh one
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="duelframe-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="duelframe-test-")
