import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stopover.session import get_spark

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return get_spark("tests", cores="8", shuffle_partitions=4)


@pytest.fixture(scope="session")
def sf():
    return SF
