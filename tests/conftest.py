import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = os.environ.get("TRAWLNET_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from trawlnet.session import session

    at = tmp_path_factory.mktemp("shared")
    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": 4, "spark.checkpoint.dir": f"file://{at}", "spark.driver.memory": "3g", "spark.driver.host": "127.0.0.1", "spark.sql.streaming.stopTimeout": "30s"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    return DATA
