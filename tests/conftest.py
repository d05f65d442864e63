import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from rategrid.session import local_session

    ckpt = tempfile.mkdtemp(prefix="rategrid-test-ckpt-", dir="/tmp")
    s = local_session("*", shuffle_partitions=8, memory="4g", checkpoint=ckpt)
    yield s
    s.stop()
