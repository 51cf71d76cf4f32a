import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuscle.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", master="local[4]", spark__sql__shuffle__partitions=4, spark__driver__memory="6g",
                        spark__default__parallelism=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
