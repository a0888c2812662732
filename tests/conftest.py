import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from loadstats.session import checkpoint_root, get_spark
    s = get_spark("local[4]", 8)
    checkpoint_root(s)
    yield s
    s.stop()
