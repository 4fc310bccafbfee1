import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from workload.session import session

    return session(memory="6g")


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are not there")
    return SMALL


@pytest.fixture(scope="session")
def data(spark, sf):
    """The adapter's provider, stored once so that the tests run on short plans."""
    from shotspark.scale import materialize
    from shotspark.sources.tables import ShotData
    from workload import adapter

    d = adapter.data(spark, sf)
    return ShotData(
        games=materialize(d.games), actions=materialize(d.actions), teams=materialize(d.teams),
        players=materialize(d.players), hot=None,
    )
