import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyscope.session import get_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", app="tallyscope-tests", shuffle_partitions=4,
                    extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()
