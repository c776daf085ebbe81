import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from plumbob.session import local_session

    return local_session("plumbob-tests", 8, spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def data():
    return DATA
