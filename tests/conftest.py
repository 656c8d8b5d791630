import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tickloom.session import CHUNK_ROWS_CONF, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    yield session
    session.stop()


@pytest.fixture
def tiny_chunks(spark):
    """Chunks of 48 rows, so every ordered operator crosses many chunk borders."""
    spark.conf.set(CHUNK_ROWS_CONF, "48")
    yield spark
    spark.conf.unset(CHUNK_ROWS_CONF)
