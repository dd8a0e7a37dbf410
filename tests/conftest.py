from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pregame.session import build_session, prepare

    session = build_session("local[8]", 8, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def duck():
    from check_oracle import connect

    return connect(SMALL)


@pytest.fixture
def tiny_blocks(spark):
    """Every key with more than a handful of rows counts as hot."""
    spark.conf.set("pregame.maxGroupRows", "7")
    yield
    spark.conf.unset("pregame.maxGroupRows")


def rows(df, *order):
    return sorted((tuple(r) for r in df.select(*order).collect()), key=repr) if order else sorted(map(tuple, df.collect()), key=repr)
