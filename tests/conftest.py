import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path[:0] = [str(HERE.parent), str(HERE)]


@pytest.fixture(scope="session")
def spark():
    from session import local_session

    return local_session()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
