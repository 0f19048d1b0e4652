import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from paths import SF01  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from eventlens.session import get_session
    s = get_session("local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def t01(spark):
    from eventlens.plans import tables
    return tables(spark, SF01)
