import pytest

from tidemark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", spark__sql__shuffle__partitions="8")
    yield session
    session.stop()
