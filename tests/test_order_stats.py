"""Quantiles by range histograms against sorting, down to ranges of one value."""

from __future__ import annotations

import math
import random

import pytest

from pregame.operators import aggregates, modelling, stats
from pregame.operators.order_stats import exact_quantiles

Q = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]


def plain(values, q):
    x = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v if not math.isnan(v) else 0))
    if not x:
        return None
    at = q * (len(x) - 1)
    low, high = math.floor(at), math.ceil(at)
    return x[low] if low == high or x[low] == x[high] else (high - at) * x[low] + (at - low) * x[high]


def same(a, b):
    return a == b or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-15)))


@pytest.mark.parametrize(("cells", "few"), [(4_096, 1_000), (64, 3)])
def test_quantiles_equal_sorting(spark, cells, few):
    rng = random.Random(cells)
    n = 700
    columns = {
        "ties": [float(rng.randrange(4)) for _ in range(n)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-4, 4) for _ in range(n)],
        "near": [1.0 + rng.randrange(90) * 2.0**-52 for _ in range(n)],
        "holes": [None if rng.random() < 0.4 else rng.gauss(0, 1) for _ in range(n)],
        "odd": [rng.choice([float("inf"), float("-inf"), float("nan"), 0.0, -3.5, 1e308, -1e308]) for _ in range(n)],
        "tiny": [rng.randrange(50) * 5e-324 for _ in range(n)],
        "none": [None] * n,
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns))
    got = exact_quantiles(df, {c: Q for c in columns}, cells, few)
    for c, values in columns.items():
        assert all(same(a, plain(values, q)) for a, q in zip(got[c], Q, strict=True)), c


def test_quantiles_of_no_rows(spark):
    empty = spark.createDataFrame([], "x double, y int")
    assert exact_quantiles(empty, {"x": [0.5], "y": [0.1, 0.9]}) == {"x": [None], "y": [None, None]}
    assert aggregates.describe_distribution(empty, "x", [0.5], [1.0]).first().q50 is None
    assert modelling.impute_median(empty, empty, ["x"]).count() == 0


def test_no_plan_gathers_a_column(spark):
    """The callers hold edges as literals: no percentile buffer, no join for them."""
    df = spark.range(1_000).selectExpr("id * 0.001 AS p", "id % 2 AS y", "id AS season")
    for out in (
        stats.calibration_bins(df, "y", "p", strategy="quantile"), aggregates.quartile_summary(df, "p", "y"), aggregates.describe_distribution(df, "p", [0.5], [0.5]),
        modelling.impute_median(df, df, ["p"]), modelling.naive_prediction(df, "season < 500", "p", "median"),
    ):
        plan = out._jdf.queryExecution().toString()
        assert "percentile" not in plan.lower()
