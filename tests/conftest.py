import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from calibra.session import ensure_checkpoint_dir, get_spark
    s = get_spark("local[*]", 8, app_name="calibra-tests")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()
