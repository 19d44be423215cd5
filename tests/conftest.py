import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(
        "tests", cores="8", shuffle_partitions=4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared"))
    )


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
