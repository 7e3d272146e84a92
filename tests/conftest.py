import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidefeed.session import local_session  # noqa: E402

# The SQL checks run on this folder of tables.
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", shared=tempfile.mkdtemp(prefix="tidefeed-shared-"))
    session.sparkContext.setLogLevel("OFF")
    # Small tables would otherwise be merged into one slice, and no key would cross slices.
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield session
    session.stop()


@pytest.fixture
def folder():
    """A new folder for the files of one test."""
    return tempfile.mkdtemp(prefix="tidefeed-test-")
