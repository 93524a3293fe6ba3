import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from netloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 2, "4g")
    yield session
    session.stop()
