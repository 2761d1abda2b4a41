import os

import pytest

from tessera.session import build_session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", partitions=4, memory="4g")


@pytest.fixture(scope="session")
def sf_dir():
    return SF
