import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from preftable.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, app="preftable-tests")
    yield s
    s.stop()


def approx_list(xs, ys, tol=1e-5):
    assert len(xs) == len(ys), (xs, ys)
    for x, y in zip(xs, ys):
        assert abs(x - y) <= tol, (xs, ys)
