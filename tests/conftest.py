import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quizmart.session import get_session
    s = get_session("local[4]", app="quizmart-tests", shuffle_partitions=8)
    yield s
    s.stop()


def rows(df, *cols, order=None):
    """Collect ``df`` as sorted tuples (order-insensitive comparisons)."""
    cols = cols or tuple(df.columns)
    out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t)) if order is None else out
