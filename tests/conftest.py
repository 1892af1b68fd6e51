import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_spark

    return get_spark(cores=8, shuffle_partitions=8, app="tests")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
