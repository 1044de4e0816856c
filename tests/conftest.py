import pytest

from quarterdeck.session import build_session
from registry import load

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("quarterdeck-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session", autouse=True)
def registered():
    load()


@pytest.fixture
def rows(spark):
    """rows(schema, data) -> DataFrame"""
    return lambda schema, data: spark.createDataFrame(data, schema)
