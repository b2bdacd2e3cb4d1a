import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from siltstream.session import build_session

    session = build_session(cores="4", shuffle_partitions=4, **{"spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
