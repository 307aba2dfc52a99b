import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


def cut_groups(monkeypatch, ranges):
    """Every group takes the range-sorted plan with that many ranges; None: the default."""
    from gradus.functions import ranking
    if ranges is not None:
        monkeypatch.setattr(ranking, "BIG", 0)
        monkeypatch.setattr(ranking, "RANGES", ranges)


@pytest.fixture(scope="session")
def spark():
    from gradus.session import get_session
    s = get_session("local[4]", 4, extra={
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="gradus-test-ckpt-"), "spark.driver.memory": "4g",
        # tiny inputs: compiling a stage takes longer than interpreting it
        "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        "spark.default.parallelism": "4", "spark.sql.sources.parallelPartitionDiscovery.threshold": "1000"})
    yield s
    s.stop()
