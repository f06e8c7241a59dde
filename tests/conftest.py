import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scholia.session import build_session  # noqa: E402
from tests.compare import connect  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("8", "tests")


@pytest.fixture(scope="session")
def con():
    return connect(SF)
