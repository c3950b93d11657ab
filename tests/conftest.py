import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loamgrid.session import local_session

    held = tmp_path_factory.mktemp("spark")
    session = local_session(
        4, "6g", **{"spark.checkpoint.dir": f"file://{held}/shared", "spark.local.dir": f"{held}/local", "spark.sql.warehouse.dir": f"{held}/warehouse"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
