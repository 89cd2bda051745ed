from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ledgerloom.session import local_session  # noqa: E402
from ledgerloom.streaming.online import STATE_STORE  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", **STATE_STORE)


@pytest.fixture(scope="session")
def data() -> str:
    path = "/root/testdata/sf0.001"
    if not Path(path).exists():
        pytest.skip("no test data here")
    return path
