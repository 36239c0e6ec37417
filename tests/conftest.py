import pytest


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sparrowmill.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session("tests", **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{shared}"})
    session.sparkContext.setLogLevel("ERROR")
    return session
