import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sessionlog.spark import get_session
    s = get_session(cpus=4, shuffle_partitions=4, app="tests")
    yield s
    s.stop()
