import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sieveline.session import local_session
    session = local_session("*", shuffle_partitions=8, memory="6g",
                            checkpoint_dir=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def make_files(spark):
    def make(*rows):
        """Files from ``(language, source)`` pairs, numbered from 0."""
        return spark.createDataFrame(
            [(n, "p", f"f{n}", language, source) for n, (language, source) in enumerate(rows)],
            "file_id long, project_id string, filename string, language string, source string")
    return make
