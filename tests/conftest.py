import pytest

from shelfloom.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(8, partitions=4, name="tests", shared=str(shared))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
