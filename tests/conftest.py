import pytest

from tallyloom.session import local_session, repo_on_worker_path


@pytest.fixture(scope="session")
def spark():
    repo_on_worker_path()
    session = local_session(4, "tests")
    yield session
    session.stop()
