import os
import tempfile

import pytest

os.environ.setdefault("EXPRLAKE_SCRATCH", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


@pytest.fixture(scope="session")
def spark():
    from exprlake.session import build_session

    s = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
           "spark.ui.showConsoleProgress": "false"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"
