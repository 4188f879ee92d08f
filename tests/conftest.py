import pytest

from loomspark.session import build


@pytest.fixture(scope="session")
def spark():
    session = build("local[8]", "tests", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
