import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tablewright.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def quirks(spark):
    """A small table with NaN next to NULL, ties, a constant and an empty column."""
    nan = float("nan")
    return spark.createDataFrame(
        [
            (1, 1.0, "a", True, 5.0, None, 10),
            (2, nan, "a", False, 5.0, None, None),
            (3, None, "b", None, 5.0, None, 30),
            (4, 4.0, "b", True, 5.0, None, 30),
            (5, 100.0, None, True, 5.0, None, 11),
        ],
        "id bigint, x double, k string, b boolean, constant double, empty double, `odd.name` bigint",
    )


def rows(df):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))
