import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from weirline.session import local_session
    s = local_session("*", 8, app="weirline-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def con_small():
    from compare import duck
    return duck(SF_SMALL)
