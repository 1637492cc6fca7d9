import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from claimlens.plans.session import build_session
    ckpt = tempfile.mkdtemp(prefix="claimlens-test-ckpt-")
    s = build_session("local[4]", app_name="claimlens-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": ckpt,
                             "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="claimlens-wh-")})
    yield s
    s.stop()
