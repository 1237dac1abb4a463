import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from plantwatch.session import build_session
    s = build_session("plantwatch-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def tiny_tasks(spark):
    """Let a task sort 25 rows only, so that every path for big groups is taken."""
    from plantwatch.session import ROWS_PER_TASK_KEY
    spark.conf.set(ROWS_PER_TASK_KEY, "25")
    yield 25
    spark.conf.unset(ROWS_PER_TASK_KEY)
