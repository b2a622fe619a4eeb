import pytest

from lorestone.session import local_session, ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    s = local_session("4", 4, spark__checkpoint__dir=str(folder / "shared"), spark__sql__warehouse__dir=str(folder / "warehouse"))
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s
