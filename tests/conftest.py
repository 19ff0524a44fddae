import pytest

from lodestone.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "3g", 4)
    ship(session)
    yield session
