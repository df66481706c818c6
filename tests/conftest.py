import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from folioscope.session import local_session

    s = local_session(4, 4, "6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
