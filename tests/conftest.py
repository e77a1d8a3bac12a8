import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from helpgrid.session import local_session

    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.addPyFile(str(Path(__file__).resolve().parent / "stubs.py"))
    yield session
    session.stop()
