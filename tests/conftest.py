import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from basketflow.session import clear_settled, local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    yield session
    clear_settled(session)
    session.stop()


@pytest.fixture
def data():
    if not os.path.isdir(DATA):
        pytest.skip("test tables are not here")
    return DATA


@pytest.fixture(autouse=True)
def usual_partitions(request):
    """Tests may change the number of shuffle partitions."""
    yield
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").conf.set("spark.sql.shuffle.partitions", 4)
