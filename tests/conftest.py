import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tidewatch.session import build_session

    session = build_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


def collect(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
