import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusloom.session import local_session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("*", "tests", **{"spark.ui.showConsoleProgress": "false"})
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Rows to a DataFrame."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def sorted_rows(df):
    return sorted(tuple(r) for r in df.collect())
