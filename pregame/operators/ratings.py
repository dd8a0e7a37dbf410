"""Elo ratings: an ordered fold per league, plus reports on its output.

The fold is sequential by definition: a game needs the ratings every earlier game of its league
left behind. What Spark distributes is everything around it: leagues, parameter cells and folds are
separate groups, only seven thin columns are shuffled, the sort is Spark's external sort, and each
group is streamed through its task in Arrow batches, so a task holds one rating per team and never
the games of a league.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pregame.functions.scalar import clip_probability, elo_expectation

BASE = 1500.0


@dataclass(frozen=True)
class EloParams:
    """``keep`` is the share of a rating's distance to the mean that survives a season boundary.

    boundary: ``team`` (each team at its own first game of a season), ``base`` (all teams at once toward
    the baseline) or ``league_mean`` (all teams at once toward the current mean).
    """

    k: float = 20.0
    keep: float = 2.0 / 3.0
    home: float = 0.0
    mov: bool = False
    boundary: str = "team"
    newcomer_offset: float = 0.0


# The five leagues' variants differ on purpose.
VARIANTS = {
    "nba": EloParams(),
    "wnba": EloParams(k=24.0, keep=0.5),
    "gleague": EloParams(k=20.0, keep=0.4, boundary="league_mean", newcomer_offset=-15.0),
    "nfl": EloParams(k=20.0, keep=0.75, home=48.0, mov=True),
    "nhl": EloParams(k=6.0, keep=0.7, home=30.0, boundary="base"),
}

_THIN = ["game_id", "season", "game_date", "home_team", "away_team", "margin", "neutral", "home_new", "away_new"]


def _thin(gm: DataFrame, scope: list[str], newcomers: DataFrame | None) -> DataFrame:
    neutral = F.col("neutral") if "neutral" in gm.columns else F.lit(False)
    extra = [c for c in ("cell", "fold") if c in scope]
    thin = gm.select(
        *scope,
        "game_id",
        "season",
        "game_date",
        "home_team",
        "away_team",
        (F.col("home_pts") - F.col("away_pts")).cast("double").alias("margin"),
        neutral.alias("neutral"),
    )
    if newcomers is None:
        return thin.withColumns({"home_new": F.lit(False), "away_new": F.lit(False)})
    base_scope = [c for c in scope if c not in extra]
    for side in ("home", "away"):
        n = newcomers.select(*base_scope, F.col("team").alias(f"{side}_team"), F.lit(True).alias(f"{side}_new"))
        thin = thin.join(n, [*base_scope, f"{side}_team"], "left").withColumn(
            f"{side}_new", F.coalesce(f"{side}_new", F.lit(False))
        )
    return thin.select(*scope, *_THIN)


def _ordered_groups(thin: DataFrame, scope: list[str]):
    """Groups whose rows reach Python in (date, id) order.

    The partition count is stated, so that adaptive execution does not merge small groups into one task:
    the bytes are few but the fold is work for a core.
    """
    parts = int(thin.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return thin.repartition(parts, *scope).sortWithinPartitions(*scope, "game_date", "game_id").groupBy(*scope)


class _Ledger:
    """Ratings of one group; scalar arithmetic for a replay, numpy rows (one per cell) for a grid."""

    def __init__(self, k, keep, home, mov: bool, boundary: str, offset: float, start):
        self.k, self.keep, self.home, self.mov = k, keep, home, mov
        self.boundary, self.offset, self.start = boundary, offset, start
        self.rating: dict = {}
        self.season_of: dict = {}
        self.season = None

    def enter(self, team, season, is_new: bool):
        if team not in self.rating:
            self.rating[team] = self.start + (self.offset if is_new else 0.0)
        elif self.boundary == "team" and self.season_of[team] != season:
            self.rating[team] = BASE + self.keep * (self.rating[team] - BASE)
        self.season_of[team] = season
        return self.rating[team]

    def turn(self, season) -> None:
        if self.boundary != "team" and self.season is not None and season != self.season and self.rating:
            mean = sum(self.rating.values()) / len(self.rating) if self.boundary == "league_mean" else BASE
            for team in self.rating:
                self.rating[team] = mean + self.keep * (self.rating[team] - mean)
        self.season = season

    def play(self, season, home_team, away_team, margin, neutral, home_new, away_new):
        self.turn(season)
        h, a = self.enter(home_team, season, home_new), self.enter(away_team, season, away_new)
        edge = h - a if neutral else h + self.home - a
        expected = 1.0 / (1.0 + 10.0 ** (-edge / 400.0))
        actual = 1.0 if margin > 0 else 0.0 if margin < 0 else 0.5
        change = self.k * (actual - expected)
        if self.mov:
            toward = edge if margin > 0 else -edge if margin < 0 else 0.0
            change = change * (np.log(abs(margin) + 1.0) * 2.2 / (0.001 * toward + 2.2))
        self.rating[home_team], self.rating[away_team] = h + change, a - change
        return h, a, expected, h + change, a - change


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches as they come; refuses a group that is not in (date, id) order."""
    last = None
    for pdf in batches:
        if len(pdf):
            first = (pdf["game_date"].iloc[0], pdf["game_id"].iloc[0])
            if last is not None and first < last:
                raise ValueError("rating fold received games out of order")
            last = (pdf["game_date"].iloc[-1], pdf["game_id"].iloc[-1])
            yield pdf


_PLAY_COLS = ["season", "home_team", "away_team", "margin", "neutral", "home_new", "away_new"]


def _replay_fn(params: EloParams, scope: list[str], cells: list[EloParams] | None = None) -> Callable:
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ledger = None
        for pdf in _in_order(batches):
            if ledger is None:
                p = cells[int(pdf["cell"].iloc[0])] if cells else params
                ledger = _Ledger(p.k, p.keep, p.home, p.mov, p.boundary, p.newcomer_offset, BASE)
            rows = [ledger.play(*r) for r in pdf[_PLAY_COLS].itertuples(index=False, name=None)]
            out = pd.DataFrame(rows, columns=["home_elo", "away_elo", "home_expected", "home_post", "away_post"])
            for c in [*scope, "game_id"]:
                out[c] = pdf[c].to_numpy()
            yield out

    return fold


def elo_replay(
    gm: DataFrame,
    params: EloParams,
    scope: list[str] = ["league"],  # noqa: B006
    newcomers: DataFrame | None = None,
    cells: list[EloParams] | None = None,
) -> DataFrame:
    """Pre-game ratings, expectation and post-game ratings per game.

    ``gm`` needs game_id, season, game_date, home_team, away_team, home_pts, away_pts (and ``neutral``
    if known). With ``cells`` the scope holds a ``cell`` column that picks each group's parameters.
    """
    types = dict(gm.dtypes)
    schema = ", ".join(
        ["home_elo double, away_elo double, home_expected double, home_post double, away_post double"]
        + [f"{c} {types[c]}" for c in [*scope, "game_id"]]
    )
    thin = _thin(gm, scope, newcomers)
    return _ordered_groups(thin, scope).applyInPandas(_iterator(_replay_fn(params, scope, cells)), schema)


def _iterator(fn: Callable) -> Callable:
    """Give the fold the annotations by which Spark picks the streaming form of applyInPandas."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from fn(batches)

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return run


def with_elo(gm: DataFrame, params: EloParams, scope: list[str] = ["league"]) -> DataFrame:  # noqa: B006
    return gm.join(elo_replay(gm, params, scope), [*scope, "game_id"])


def rating_states(gm: DataFrame, replay: DataFrame, scope: list[str]) -> DataFrame:
    """Post-game state per team: (scope, team, game_date, game_id, season, rating)."""
    home = F.struct(F.col("home_team").alias("team"), F.col("home_post").alias("rating"), F.col("home_elo").alias("pre"))
    away = F.struct(F.col("away_team").alias("team"), F.col("away_post").alias("rating"), F.col("away_elo").alias("pre"))
    j = gm.select(*scope, "game_id", "game_date", "season", "home_team", "away_team").join(replay, [*scope, "game_id"])
    return j.select(*scope, "game_id", "game_date", "season", F.explode(F.array(home, away)).alias("s")).select(
        *scope, "game_id", "game_date", "season", "s.*"
    )


def elo_as_of(fixture_sides: DataFrame, states: DataFrame, params: EloParams, scope: list[str]) -> DataFrame:
    """Rating each side takes into a fixture; the season boundary is applied on read.

    A team without history has the baseline plus the newcomers' offset. With boundary ``base`` every elapsed season
    pulls once; ``league_mean`` pulls toward the mean of the ratings with which the teams ended earlier seasons.
    """
    from pregame.operators.asof import asof_before

    states = states.withColumnRenamed("season", "state_season")
    got = asof_before(fixture_sides, states, [*scope, "team"], ["rating", "state_season"])
    moved = F.col("state_season") != F.col("season")
    if params.boundary == "league_mean":
        ends = states.groupBy(*scope, "team", "state_season").agg(F.max_by("rating", F.struct("game_date", "game_id")).alias("_r"))
        asked = fixture_sides.select(*scope, "season").distinct()
        latest = ends.join(asked, scope).filter("state_season < season").groupBy(*scope, "season", "team").agg(F.max_by("_r", "state_season").alias("_r"))
        mean = latest.groupBy(*scope, "season").agg(F.avg("_r").alias("_mean"))
        got = got.join(mean, [*scope, "season"], "left")
        center, power = F.col("_mean"), F.lit(1)
    else:
        center = F.lit(BASE)
        power = F.col("season") - F.col("state_season") if params.boundary == "base" else F.lit(1)
    pulled = center + F.pow(F.lit(params.keep), power) * (F.col("rating") - center)
    entering = F.when(F.col("rating").isNull(), F.lit(BASE + (params.newcomer_offset or 0.0))).when(moved, pulled).otherwise(F.col("rating"))
    return got.withColumn("elo_entering", entering).drop("_mean", "rating", "state_season")


# ---- parameter grid -----------------------------------------------------------------------------


def grid_cells(base: EloParams, k: list[float], keep: list[float], home: list[float]) -> list[EloParams]:
    """Cells in nested-loop order; the position is the tie-break of the search."""
    return [replace(base, k=a, keep=b, home=c) for a in k for b in keep for c in home]


def elo_grid_losses(gm: DataFrame, cells: list[EloParams], scope: list[str], chunk: int = 64) -> DataFrame:
    """Log-loss sum and count per (scope, season, cell). Ties are replayed but not scored.

    Cells travel as numpy vectors, ``chunk`` to a group: a game is shuffled once per chunk, not once per cell.
    """
    parts = [cells[i : i + chunk] for i in range(0, len(cells), chunk)]
    thin = _thin(gm, scope, None).select("*", F.explode(F.array(*[F.lit(i) for i in range(len(parts))])).alias("part"))
    keys = [*scope, "part"]
    types = dict(thin.dtypes)
    specs = [[asdict(c) for c in p] for p in parts]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ledger, sums, head, first = None, {}, None, 0
        for pdf in _in_order(batches):
            if ledger is None:
                part = int(pdf["part"].iloc[0])
                spec = specs[part]
                head = {c: pdf[c].iloc[0] for c in scope}
                first = part * chunk
                arr = {n: np.array([s[n] for s in spec]) for n in ("k", "keep", "home")}
                ledger = _Ledger(
                    arr["k"], arr["keep"], arr["home"], spec[0]["mov"], spec[0]["boundary"], 0.0, np.full(len(spec), BASE)
                )
            for row in pdf[_PLAY_COLS].itertuples(index=False, name=None):
                expected = ledger.play(*row)[2]
                if row[3] != 0:
                    p = np.clip(expected, 1e-15, 1 - 1e-15)
                    loss, n = sums.get(row[0], (0.0, 0))
                    sums[row[0]] = (loss - np.log(p if row[3] > 0 else 1 - p), n + 1)
        for season, (loss, n) in sums.items():
            out = pd.DataFrame({"cell": np.arange(len(loss)) + first, "loss": loss})
            out["season"], out["n"] = season, n
            for c, v in head.items():
                out[c] = v
            yield out

    schema = ", ".join(["cell int, loss double, season int, n bigint"] + [f"{c} {types[c]}" for c in scope])
    return _ordered_groups(thin, keys).applyInPandas(_iterator(fold), schema)


def best_cells(losses: DataFrame, scope: list[str]) -> DataFrame:
    """Cell with the least mean loss per scope; the first in grid order on a tie."""
    per = losses.groupBy(*scope, "cell").agg((F.sum("loss") / F.sum("n")).alias("log_loss"))
    best = per.groupBy(*scope).agg(F.min(F.struct("log_loss", "cell")).alias("b"))
    return best.select(*scope, "b.cell", "b.log_loss")


def elo_grid(gm: DataFrame, cells: list[EloParams], train_seasons: list[int], scope: list[str]) -> DataFrame:
    losses = elo_grid_losses(gm, cells, scope)
    best = best_cells(losses.filter(F.col("season").isin(train_seasons)), scope)
    return best.select("*", *_cell_columns(cells))


def _cell_columns(cells: list[EloParams]) -> list[Column]:
    out = []
    for name in ("k", "keep", "home"):
        values = F.array(*[F.lit(float(getattr(c, name))) for c in cells])
        out.append(F.get(values, F.col("cell")).alias(name))
    return out


def fold_elo(gm: DataFrame, cells: list[EloParams], folds: list[int], scope: list[str]) -> DataFrame:
    """Ratings refitted per fold: parameters chosen on seasons before the fold, games replayed through it.

    One grid pass serves every fold, because losses are kept per season.
    """
    fold = F.explode(F.array(*[F.lit(f) for f in folds])).alias("fold")
    losses = elo_grid_losses(gm, cells, scope).select("*", fold).filter(F.col("season") < F.col("fold"))
    chosen = best_cells(losses, [*scope, "fold"]).drop("log_loss")
    wide = gm.select("*", fold).filter(F.col("season") <= F.col("fold")).join(chosen, [*scope, "fold"])
    return elo_replay(wide, cells[0], [*scope, "fold", "cell"], None, cells)


# ---- reports ------------------------------------------------------------------------------------


def elo_alone(gm: DataFrame, train: Column, home_edge: float = 0.0) -> DataFrame:
    """Winner probability and a margin from a one-feature fit on the rating difference (``train`` rows).

    ``gm`` carries home_elo, away_elo. The fit is two aggregates, one row joined back.
    """
    diff = F.col("home_elo") - F.col("away_elo")
    margin = F.col("home_pts") - F.col("away_pts")
    fit = gm.filter(train).agg(F.regr_slope(margin, diff).alias("_b"), F.regr_intercept(margin, diff).alias("_a"))
    return (
        gm.crossJoin(F.broadcast(fit))  # one row
        .withColumns(
            {
                "elo_prob": elo_expectation(F.col("home_elo"), F.col("away_elo"), home_edge),
                "elo_margin": F.col("_a") + F.col("_b") * diff,
            }
        )
        .drop("_a", "_b")
    )


def season_end_ratings(states: DataFrame, scope: list[str]) -> DataFrame:
    return states.groupBy(*scope, "team", "season").agg(
        F.max_by("rating", F.struct("game_date", "game_id")).alias("end_rating")
    )


def expansion_offset(states: DataFrame, newcomers: DataFrame, scope: list[str], draws: int, seed: int = 7) -> DataFrame:
    """Newcomers' rating at the end of their first season: mean, 95 % interval, offset 0 if it spans 0."""
    from pregame.operators.stats import bootstrap_mean, stable_id

    ends = season_end_ratings(states, scope).join(
        newcomers.select(*scope, "team", F.col("first_season").alias("season")), [*scope, "team", "season"]
    )
    shown = ends.select((F.col("end_rating") - BASE).alias("x"), stable_id(*scope, "team").alias("row_id"))
    out = bootstrap_mean(shown, "x", draws, seed)
    spans = (F.col("lo") <= 0) & (F.col("hi") >= 0)
    return out.withColumns({"spans_zero": spans, "offset": F.when(spans, F.lit(0.0)).otherwise(F.col("mean"))})


def elo_continuity(states: DataFrame, identity: DataFrame, params: EloParams, scope: list[str]) -> DataFrame:
    """First rating of each later season beside the one carried over, with the label change.

    A renamed or moved team that restarted at the baseline shows a non-zero ``gap``.
    """
    per = states.groupBy(*scope, "team", "season").agg(
        F.min_by("pre", F.struct("game_date", "game_id")).alias("first_rating"),
        F.max_by("rating", F.struct("game_date", "game_id")).alias("end_rating"),
    )
    # One row per team and season: the window is over seasons.
    w = Window.partitionBy(*scope, "team").orderBy("season")
    prev = per.withColumn("_prev", F.lag("end_rating").over(w)).filter(F.col("_prev").isNotNull())
    ident = identity.select(*scope, "team", "season", "label", "previous", "changed")
    expected = BASE + params.keep * (F.col("_prev") - BASE)
    return prev.join(ident, [*scope, "team", "season"], "left").select(
        *scope, "team", "season", "label", "changed", "first_rating",
        expected.alias("carried_rating"), (F.col("first_rating") - expected).alias("gap"),
    )


def expansion_drift(states: DataFrame, newcomers: DataFrame, scope: list[str], limit: float = 30.0) -> DataFrame:
    """Debut season of each newcomer: start, end, least and greatest rating and a verdict."""
    debut = newcomers.select(*scope, "team", F.col("first_season").alias("season"))
    order = F.struct("game_date", "game_id")
    out = (
        states.join(debut, [*scope, "team", "season"])
        .groupBy(*scope, "team", "season")
        .agg(
            F.count(F.lit(1)).alias("games"),
            F.min_by("pre", order).alias("start_rating"),
            F.max_by("rating", order).alias("end_rating"),
            F.min("rating").alias("min_rating"),
            F.max("rating").alias("max_rating"),
        )
    )
    d = F.col("end_rating") - F.col("start_rating")
    verdict = F.when(d > limit, "starts too low").when(d < -limit, "starts too high").otherwise("settled")
    return out.withColumn("verdict", verdict)


def log_loss_term(p: Column, y: Column) -> Column:
    q = clip_probability(p)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))
