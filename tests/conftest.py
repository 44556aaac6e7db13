import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from baitlens.session import build_session  # noqa: E402


SESSION = build_session("tests", "local[4]", **{
    "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
    "spark.checkpoint.dir": tempfile.mkdtemp(prefix="baitlens-tests-"),
})
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture
def one(spark):
    """Values of column expressions over one literal row."""
    def run(value, *expressions, kind="string"):
        row = spark.createDataFrame([(value,)], f"v {kind}").select(*expressions).first()
        return row[0] if len(expressions) == 1 else tuple(row)

    return run
