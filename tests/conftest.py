import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for the workers


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from eventgraph.session import local_session

    folder = tmp_path_factory.mktemp("spark")
    return local_session(4, partitions=4, memory="4g", **{"spark.sql.warehouse.dir": f"file://{folder}/warehouse", "spark.checkpoint.dir": f"file://{folder}/checkpoints"})


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
