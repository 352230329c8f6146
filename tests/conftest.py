import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from folioscope.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
                               "spark.checkpoint.dir": str(tmp_path_factory.mktemp("cut"))})


@pytest.fixture(scope="session")
def sf():
    return SF
