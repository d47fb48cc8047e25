from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark():
    from hustings.session import build_session

    s = build_session("tests", 4, 4, spark__driver__memory="4g", spark__sql__warehouse__dir="/tmp/spark-hustings-warehouse")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
