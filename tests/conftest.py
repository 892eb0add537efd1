import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from turnwise.session import build_session
    s = build_session("local[4]", app="turnwise-tests", shuffle_partitions=4)
    yield s
    s.stop()


def rows(df, cols=None):
    """Sorted list of tuples (order-insensitive comparison helper)."""
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
