import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["TZ"] = "UTC"


@pytest.fixture(scope="session")
def spark():
    from strandline.session import local_session

    s = local_session(cores=8, partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
