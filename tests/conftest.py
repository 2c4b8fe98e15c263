import atexit
import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from quern.session import session

    shared = tempfile.TemporaryDirectory(prefix="quern-tests-")
    atexit.register(shared.cleanup)
    s = session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__checkpoint__dir=shared.name,
        spark__sql__warehouse__dir=f"{shared.name}/warehouse",
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return DATA
