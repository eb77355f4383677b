import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shredloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parents[1])
    yield session
    session.stop()
