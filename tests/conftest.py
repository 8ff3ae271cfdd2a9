import pytest

from textloom.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    conf = {"spark.sql.warehouse.dir": str(folder / "warehouse"), "spark.checkpoint.dir": str(folder / "shared")}
    session = local_session(4, "4g", **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
