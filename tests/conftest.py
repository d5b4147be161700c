import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallyrake.session import get_spark
    s = get_spark("local[4]", 4, app_name="tallyrake-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="tallyrake-test-")


SMALL_SF = "/root/testdata/sf0.001"
