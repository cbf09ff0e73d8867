import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest


@pytest.fixture(scope="session")
def spark():
    from siftline.session import local_session

    session = local_session(cores=4)
    session.conf.set("spark.sql.shuffle.partitions", "3")
    session.sparkContext.setLogLevel("ERROR")
    return session
