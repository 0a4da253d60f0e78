import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quillgraph.session import drop_intermediates, get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_intermediates(session)
