import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from paritas.session import session

    s = session("tests", "8", 8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    from oracle import DATA

    return DATA / "sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    from oracle import connect

    return connect(small)
