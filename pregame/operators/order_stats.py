"""Exact quantiles by successive range histograms.

An exact percentile in one aggregate keeps every distinct value in one buffer. Here each round counts the rows per cell of
the ranges that still hold a wanted rank, with the smallest and largest value of each cell, and keeps the cells the
ranks fall into. All columns and ranks share a round. What comes to the driver is at most ``cells`` rows per range and,
at the end, ``few`` values per range; two or three rounds serve billions of rows. Values spread over many powers of ten take a
round for every three or so of them.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pregame.session import shared_dir

CELLS, FEW = 4_096, 1_000


@dataclass
class _Range:
    """Finite values of a column from ``low`` to ``high``: ``count`` of them after ``before`` smaller ones, and the ranks wanted among them."""

    column: int
    low: float
    high: float
    before: int
    count: int
    ranks: list[int]


def _cell(x: Column, r: _Range, cells: int) -> Column:
    """Cell of a value, rising with it. Halves keep the width finite; without a width the smallest value parts from the rest."""
    width = r.high / 2 - r.low / 2
    if not (width > 0 and math.isfinite(cells / width)):
        return (x > F.lit(r.low)).cast("int")
    return F.least(F.floor((x / 2 - F.lit(r.low / 2)) / F.lit(width) * cells), F.lit(cells - 1)).cast("int")


def _narrowed(thin: DataFrame, open_: list[_Range], cells: int) -> list[_Range]:
    hits = [
        F.when((x >= F.lit(r.low)) & (x <= F.lit(r.high)), F.struct(F.lit(i).alias("range"), _cell(x, r, cells).alias("cell"), x.alias("x")))
        for i, r in enumerate(open_)
        for x in [F.col(f"c{r.column}")]
    ]
    counted = (
        thin.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).groupBy("h.range", "h.cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("h.x").alias("low"), F.max("h.x").alias("high")).orderBy("range", "cell").collect()
    )
    out, before, at = [], 0, -1
    for row in counted:
        r = open_[row.range]
        if row.range != at:
            at, before = row.range, r.before
        mine = [k for k in r.ranks if before <= k < before + row.n]
        if mine:
            out.append(_Range(r.column, row.low, row.high, before, row.n, mine))
        before += row.n
    return out


def _values(thin: DataFrame, small: list[_Range]) -> dict[tuple[int, int], float]:
    """Values of the ranks of ranges with few rows."""
    if not small:
        return {}
    hits = [
        F.when((x >= F.lit(r.low)) & (x <= F.lit(r.high)), F.struct(F.lit(i).alias("range"), x.alias("x")))
        for i, r in enumerate(small)
        for x in [F.col(f"c{r.column}")]
    ]
    held: dict[int, list[float]] = {}
    for row in thin.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).select("h.*").collect():
        held.setdefault(row.range, []).append(row.x)
    return {(r.column, k): sorted(held[i])[k - r.before] for i, r in enumerate(small) for k in r.ranks}


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], cells: int = CELLS, few: int = FEW) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column's values that are not null; None for a column without any.

    Not-a-number counts as larger than every number. The columns are written once as a thin table, which each round reads.
    """
    spark = df.sparkSession
    names = list(wanted)
    path = f"{shared_dir(spark)}/quantiles-{uuid.uuid4().hex}"
    df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]).write.parquet(path)
    thin = spark.read.parquet(path)
    inf = F.lit(float("inf"))
    one = []
    for i in range(len(names)):
        x = F.col(f"c{i}")
        finite = F.when(~F.isnan(x) & (F.abs(x) < inf), x)
        one += [F.count_if(x == -inf).alias(f"below{i}"), F.count(finite).alias(f"n{i}"), F.count_if(~F.isnan(x) & (x == inf)).alias(f"above{i}"), F.count(x).alias(f"all{i}")]
        one += [F.min(finite).alias(f"low{i}"), F.max(finite).alias(f"high{i}")]
    seen = thin.agg(*one).first()
    found: dict[tuple[int, int], float] = {}
    open_: list[_Range] = []
    for i, c in enumerate(names):
        n, below, finite = seen[f"all{i}"], seen[f"below{i}"], seen[f"n{i}"]
        ranks = sorted({k for q in wanted[c] for k in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))}) if n else []
        for k in ranks:
            if k < below:
                found[i, k] = -math.inf
            elif k >= below + finite:
                found[i, k] = math.inf if k < below + finite + seen[f"above{i}"] else math.nan
        inner = [k for k in ranks if below <= k < below + finite]
        if inner:
            open_.append(_Range(i, seen[f"low{i}"], seen[f"high{i}"], below, finite, inner))
    small: list[_Range] = []
    while open_:
        found |= {(r.column, k): r.low for r in open_ if r.low == r.high for k in r.ranks}
        small += [r for r in open_ if r.low < r.high and r.count <= few]
        open_ = [r for r in open_ if r.low < r.high and r.count > few]
        if open_:
            open_ = _narrowed(thin, open_, cells)
    found |= _values(thin, small)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(names):
        n = seen[f"all{i}"]
        out[c] = []
        for q in wanted[c]:
            if not n:
                out[c].append(None)
                continue
            at = q * (n - 1)
            low, high = math.floor(at), math.ceil(at)
            a, b = found[i, low], found[i, high]
            out[c].append(a if low == high or a == b else (high - at) * a + (at - low) * b)
    return out
