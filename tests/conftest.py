import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from kerbline.runtime import session

    spark = session("tests", "4")
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
