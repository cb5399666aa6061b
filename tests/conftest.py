import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from seriesloom.operators.skew import Limits  # noqa: E402
from seriesloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture
def tight():
    """Limits so low that every join splits its keys, nothing is broadcast as a whole and no values are listed."""
    return Limits(broadcast_bytes=0, rows_per_piece=7, max_split_keys=1000, listed_rows=0)
