import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from knnhard.session import get_spark

    return get_spark(master="local[4]", partitions=8)


@pytest.fixture(scope="session")
def duck():
    from oracle_check import duck as mk

    return mk(SF)
