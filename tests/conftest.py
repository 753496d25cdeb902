import os
import sys
from pathlib import Path

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")  # many small matrices beside many tasks

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from papyrine.session import build_session

    session = build_session("tests", cpus=4, memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


DATA = "/root/testdata/sf0.001"
