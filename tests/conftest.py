import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session, ship_package

    session = build_session("local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest test data."""
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    return folder
