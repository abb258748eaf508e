import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from folioforge.session import local_session

    return local_session(cores="4", shuffle_partitions=4, memory="3g")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
