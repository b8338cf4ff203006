from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TINY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tonearm.session import local_session

    s = local_session(4, 4, "4g", tmp_path_factory.mktemp("shared").as_uri())
    yield s
    from tonearm.storage import drop_cuts

    drop_cuts()
    s.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return TINY
