import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from saidso.session import local_session

    session = local_session(8, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "8")
    yield session
    session.stop()
