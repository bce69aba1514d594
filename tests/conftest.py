from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quantframe.session import clear_stage, get_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests")
    yield session
    clear_stage(session)


@pytest.fixture(scope="session")
def sf_dir():
    return SF
