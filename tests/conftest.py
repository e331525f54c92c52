import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lorekeep.session import build_session  # noqa: E402

# Started before the test modules are read, because their constants are columns.
SESSION = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": 4, "spark.driver.memory": "4g"})
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()
