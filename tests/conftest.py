import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tableprep.session import checkpoint_dir, local_session

    s = local_session(app="tableprep-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def files():
    import fixtures

    root = tempfile.mkdtemp(prefix="tableprep-fixtures-")
    return fixtures.write_all(root)


@pytest.fixture()
def outdir():
    return tempfile.mkdtemp(prefix="tableprep-out-")
