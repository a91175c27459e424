import pytest


@pytest.fixture(scope="session")
def docs_dir(sf_dir):
    return sf_dir
