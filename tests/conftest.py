import os
import sys
from datetime import datetime
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
# Python workers import the package and the tests' own helpers.
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), str(ROOT / "tests"), os.environ.get("PYTHONPATH", "")])

from recallspark.session import local_session  # noqa: E402

AS_OF = datetime(2024, 1, 15, 10, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", shuffle_partitions=8)
    yield session
    session.stop()


@pytest.fixture
def as_of():
    return AS_OF
