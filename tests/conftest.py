import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lumatlas.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, shuffle_partitions=4, app="tests")


@pytest.fixture(scope="session")
def views(spark):
    from lumatlas.plans.views import Views

    return Views(spark, SF)
