import pytest

from wayline.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", cores=4, partitions=4)
    yield session
    session.stop()
