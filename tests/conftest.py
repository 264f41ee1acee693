import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from harborline import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    built = session.tune(session.build("harborline-tests"))
    built.sparkContext.setLogLevel("ERROR")
    built.conf.set("spark.sql.shuffle.partitions", "4")
    return built
