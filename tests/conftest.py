import pytest

from sheaf.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session(
        "tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
