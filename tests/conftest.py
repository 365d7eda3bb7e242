import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("OMP_NUM_THREADS", "1")

from plumbago.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark__driver__memory="4g", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__default__parallelism="4")
    session.sparkContext.setLogLevel("ERROR")
    return session
