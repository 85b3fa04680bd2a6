import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ethospark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sequences(spark):
    """[[values of sequence 0], …] → DataFrame (identity, frame, <name>), NULL for None."""

    def build(vectors, name="state", kind="int"):
        rows = [(i, f, x) for i, v in enumerate(vectors) for f, x in enumerate(v)]
        return spark.createDataFrame(rows, f"identity int, frame int, {name} {kind}")

    return build
