import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TESTDATA = pathlib.Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from driftlens.session import local_session

    session = local_session("8", shuffle_partitions=4, name="driftlens-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not TESTDATA.exists():
        pytest.skip("test tables are not present")
    return str(TESTDATA)
