import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from strandloom.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session("4", "tests", memory="4g", **{"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.checkpoint.dir": str(shared), "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
