import pathlib
import sys
import tempfile

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tidemark-tests", spark__sql__shuffle__partitions="4")


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="tidemark-test-")
