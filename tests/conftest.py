import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidegrid.session import session

    at = tempfile.mkdtemp(prefix="spark-")
    s = session(
        "tests", "local[4]",
        spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__checkpoint__dir=f"{at}/shared", spark__sql__warehouse__dir=f"{at}/warehouse", spark__local__dir=f"{at}/local",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
