import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from funnelkit.session import get_session
    s = get_session(cores="4", shuffle_partitions=8, app="funnelkit-tests")
    yield s


@pytest.fixture(scope="session")
def crm0001(spark):
    from funnelkit.sources import crm
    return crm.load(spark, SF0001)


@pytest.fixture(scope="session")
def crm001(spark):
    from funnelkit.sources import crm
    return crm.load(spark, SF001)
