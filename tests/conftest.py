import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from webmine.session import get_session

    return get_session(master="local[4]", shuffle_partitions=8)


SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"
