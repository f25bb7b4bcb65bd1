from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from claimweft.session import get_session, ship_package

    session = ship_package(get_session("local[4]", 4, **{"spark.ui.showConsoleProgress": "false"}))
    yield session
    session.stop()
