"""Every registered query against its DuckDB oracle at sf0.01."""
import pytest

from eventlens.plans import REGISTRY
from eventlens.plans.check import compare, duck

from paths import SF01

_con = None


def _duck():
    global _con
    if _con is None:
        _con = duck(SF01)
    return _con


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, name):
    p = REGISTRY[name]
    r = compare(spark, SF01, name, p.fn, p.oracle, _duck())
    assert r["status"] == "match", r
