import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("ORIEL_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from oriel.session import local_session
    s = local_session(cores="4", shuffle_partitions=4, app="oriel-tests")
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF
