"""One local session for all tests; the folder of the library goes to the workers."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from tracewright.session import local_session

    s = local_session(4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
