import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from askloom.session import get_spark, ready  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "4", partitions=4)
    yield ready(s)
    s.stop()
