import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from kairoscope.session import get_session, ship

    session = get_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    return session
