import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
# Python workers import the package too.
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from newsdesk.session import session

    found = session("tests", "local[4]", 4)
    found.sparkContext.setLogLevel("ERROR")
    found.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield found
    found.stop()
