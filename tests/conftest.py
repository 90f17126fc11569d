import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("CORVIDA_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from corvida.session import build_session, drop_written

    s = build_session("local[4]", 4)
    yield s
    drop_written(s)
    s.stop()
