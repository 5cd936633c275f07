import pytest

from bidlake import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__sql__warehouse__dir=str(warehouse))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
