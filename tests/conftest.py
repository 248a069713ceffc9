import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pagesift.plans.session import session

    s = session(
        "local[4]",
        "tests",
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir="file://" + tempfile.mkdtemp(prefix="spark-"),
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="spark-"),
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
