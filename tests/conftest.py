import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from rowgrain.session import local_session

    s = local_session(8, "rowgrain-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def no_jobs(spark):
    """Fails the test if it starts a Spark job."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("must-not-run", "no job may run here")
    before = len(tracker.getJobIdsForGroup("must-not-run"))
    yield
    after = len(tracker.getJobIdsForGroup("must-not-run"))
    spark.sparkContext._jsc.clearJobGroup()
    assert after == before, "a job was started"
