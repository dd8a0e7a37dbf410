"""Every registered query with oracle SQL, on the smallest tables; the others must at least run."""

from __future__ import annotations

import os

import pytest
from check_oracle import compare
from conftest import SMALL

from pregame.plans.catalog import load

REGISTRY = load()
SLOW = {"stream_elo", "stream_form"}
NAMES = [n for n in REGISTRY if not (os.environ.get("PREGAME_QUICK") and n in SLOW)]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    q = REGISTRY[name]
    df = q.build(spark, SMALL)
    if q.sql is None:
        assert len(df.collect()) > 0
        return
    ok, note = compare(df, duck, q.sql)
    assert ok, note


def test_every_query_names_its_operators():
    assert all(q.covers for q in REGISTRY.values())
