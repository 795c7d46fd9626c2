import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from tsbags.session import local_session

    session = local_session(cores=4, memory="4g", shuffle=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
