import pytest

from crawlframe.operators.lineage import clear
from crawlframe.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("crawlframe-tests", master="local[8]", conf={
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
