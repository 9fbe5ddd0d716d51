import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millrace.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def inputs(spark):
    from millrace.plans.inputs import Inputs

    return Inputs(spark, SF_DIR)
