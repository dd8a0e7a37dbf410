"""Hand-made frames, refusals and plants."""

from __future__ import annotations

import datetime as dt
import random
from math import exp

import pytest
from conftest import SMALL, rows
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pregame.operators import asof, fixtures, joins, modelling, projections, quality, ratings, rest_travel, rolling, sets, stats
from pregame.plans import model_queries
from pregame.plans.catalog import load
from pregame.plans.feature_queries import game_features, side_features
from pregame.plans.util import TEAM_SEASON
from pregame.sources import files, views

D = dt.date(2020, 1, 1)


def frame(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_full_window_rule_with_null_inside(spark):
    vals = [1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0]
    df = frame(spark, [("t", D + dt.timedelta(i), i, v) for i, v in enumerate(vals)], "team string, game_date date, game_id long, v double")
    got = [r["m"] for r in rolling.trailing_mean(df, ["team"], "v", 3, "m").orderBy("game_id").collect()]
    assert got == [None, None, None, None, None, 4.0, 5.0]


def test_absence_carries_the_last_appearance_value(spark):
    data = [("p", 1, 10.0, True), ("p", 2, 20.0, True), ("p", 3, None, False), ("p", 4, 30.0, True), ("p", 5, None, False)]
    df = frame(spark, [(p, D + dt.timedelta(i), i, v, a) for p, i, v, a in data], "player string, game_date date, game_id long, v double, played boolean")
    got = [r["roll2_v"] for r in rolling.trailing_appearance_mean(df, ["player"], "played", ["v"], 2).orderBy("game_id").collect()]
    # The absence after game 4 keeps the value computed at game 4, which excludes game 4.
    assert got == [None, None, None, 15.0, 15.0]


def test_density_bounds_are_exclusive(spark):
    df = frame(spark, [("t", D + dt.timedelta(d), d) for d in (1, 2, 4, 8, 9)], "team string, game_date date, game_id long")
    got = [r["n"] for r in rest_travel.games_in_window(df, ["team"], 7, "n").orderBy("game_id").collect()]
    assert got == [0, 1, 2, 2, 2]


def test_road_trip_resets(spark):
    seq = [(1, False), (1, False), (1, True), (1, False), (2, False), (2, False)]
    df = frame(spark, [("t", s, D + dt.timedelta(i), i, h) for i, (s, h) in enumerate(seq)], "team string, season int, game_date date, game_id long, is_home boolean")
    got = [r["road_trip"] for r in rest_travel.road_trip(df, ["team", "season"]).orderBy("game_id").collect()]
    assert got == [1, 2, 0, 1, 1, 2]


def test_checked_join_refuses_duplicates_and_gaps(spark):
    left = frame(spark, [(1,), (2,)], "k int")
    right = frame(spark, [(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="many_to_one"):
        joins.join_checked(left, right, ["k"])
    with pytest.raises(PySparkException, match="no partner for 2"):
        joins.join_checked(left, right.limit(1), ["k"], on_unmatched="fail").collect()


def test_unknown_venue_and_relocation_overlap_are_fatal(spark):
    tg = frame(spark, [(1, 1, True, 9)], "game_id int, opp int, is_home boolean, team int")
    arenas = frame(spark, [(1, 1.0, 1.0, "UTC")], "team int, lat double, lon double, zone string")
    with pytest.raises(PySparkException, match="unknown venue 9"):
        rest_travel.attach_arena(rest_travel.attach_venue(tg), arenas).collect()
    both = frame(spark, [(3, 1999), (103, 1999)], "team int, season int")
    with pytest.raises(ValueError, match="overlap"):
        projections.apply_relocations(both, {103: 3})


def test_repeated_game_id_neither_multiplies_nor_guesses(spark):
    tg = frame(spark, [(1, "a", 10.0), (1, "b", 7.0), (2, "a", 1.0), (2, "b", 2.0), (2, "c", 3.0)], "game_id int, team string, pts double")
    got = rows(joins.attach_opponent(tg, ["pts"]), "game_id", "team", "opp_pts")
    assert got == sorted([(1, "a", 7.0), (1, "b", 10.0), (2, "a", None), (2, "b", None), (2, "c", None)], key=repr)


def test_predictable_and_blocking(spark):
    fx = frame(spark, [("L", 1, D, 1, 2), ("L", 2, D, 3, 4), ("L", 3, D + dt.timedelta(1), 1, 3), ("L", 4, D + dt.timedelta(2), 5, 6)], "league string, game_id int, game_date date, home_team int, away_team int")
    got = {r["game_id"]: r["predictable"] for r in fixtures.predictable(fx, ["league"]).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True}
    assert {(r["side"], r["blocked_by"]) for r in fixtures.blocking(fx, ["league"]).collect()} == {("home", 1), ("away", 2)}


def test_dedupe_keeps_stated_order(spark):
    df = frame(spark, [(1, 3, "c"), (1, 1, "a"), (1, 2, "b")], "k int, o int, v string")
    assert sets.dedupe(df, ["k"], ["o"]).first()["v"] == "a"
    assert sets.dedupe(df, ["k"], ["o"], "last").first()["v"] == "c"
    with pytest.raises(ValueError, match="selections differ"):
        sets.assert_same_rows(df, df.filter("o > 1"), ["o"])


def test_batch_row_equals_fixture_path(spark):
    """Parity: the form a played game was given is the form its fixture would have been given."""
    tg = views.team_games(spark, SMALL)
    once = quality.double_bookings(tg, ["league", "team", "game_date"]).select("league", "team", "game_date")
    stored = rolling.add_rolling(tg, ["league", "team"], ["pts"], [5], "form").join(once, ["league", "team", "game_date"], "left_anti")
    live = asof.fixture_form(tg.select("league", "team", "game_id", "game_date"), tg, ["league", "team"], ["pts"], 5)
    assert quality.truncation_differences(stored, live, ["league", "team", "game_id"], ["form5_pts"]).count() == 0


def test_planted_lookahead_is_caught(spark):
    """A window that includes the current row moves when the future is poisoned; the real one does not."""
    from pyspark.sql import Window

    def leaky(df):
        w = Window.partitionBy(*TEAM_SEASON).orderBy("game_date", "game_id").rowsBetween(-4, 1)
        return df.withColumn("f", F.avg("pts").over(w))

    honest = lambda df: rolling.trailing_mean(df, TEAM_SEASON, "pts", 5, "f")
    tg = views.team_games(spark, SMALL)
    day = F.col("game_date")
    args = (["league", "game_id", "team"], "f", day >= "1998-02-01", "pts", day < "1998-02-01")
    assert quality.corruption_effect(tg, leaky, *args).count() > 0
    assert quality.corruption_effect(tg, honest, *args).count() == 0


def test_noop_plant_is_refused(spark):
    tg = views.team_games(spark, SMALL)
    with pytest.raises(ValueError, match="changed no row"):
        quality.planted(tg, tg.withColumn("pts", F.col("pts") + 0), ["game_id"])
    bad = quality.planted(tg, tg.withColumn("pts", F.when(F.col("game_id") == 7, F.col("pts") + 1).otherwise(F.col("pts"))), ["game_id"])
    assert quality.mirror_violations(bad).count() == 1
    assert quality.mirror_violations(tg).count() == 0 and quality.game_sides(tg).count() == 0


def test_season_firewall(spark):
    df = frame(spark, [(1998,), (1999,)], "season int")
    assert modelling.refuse_seasons(df.filter("season < 1999"), [1999]).count() == 1
    with pytest.raises(PySparkException, match="held-out season"):
        modelling.refuse_seasons(df, [1999]).collect()


def test_failure_log_rejects_malformed_lines(spark, tmp_path):
    (tmp_path / "log.txt").write_text("0000000001\tno data\nbroken line\n")
    with pytest.raises(PySparkException, match="malformed line"):
        files.scan_failure_log(spark, str(tmp_path / "log.txt")).collect()


def test_manifest_round_trip(spark):
    from pregame.plans.scan_queries import manifest_of

    assert manifest_of(spark, SMALL) == {"newest": 2001, "oldest": 1994} or set(manifest_of(spark, SMALL)) == {"newest", "oldest"}


# ---- ratings ------------------------------------------------------------------------------------


def tiny_league(spark):
    g = [
        (1, 2020, 1, 2, 10.0, 5.0), (2, 2020, 3, 4, 3.0, 3.0), (3, 2020, 1, 3, 1.0, 9.0), (4, 2021, 2, 4, 7.0, 2.0), (5, 2021, 5, 1, 4.0, 6.0),
    ]
    return frame(
        spark, [("L", i, s, D + dt.timedelta(i), h, a, hp, ap, i == 4) for i, s, h, a, hp, ap in g],
        "league string, game_id long, season int, game_date date, home_team int, away_team int, home_pts double, away_pts double, neutral boolean",
    )


def by_hand(games, p):
    r, last, season, out = {}, {}, None, {}
    for g in games:
        if p.boundary != "team" and season is not None and g["season"] != season:
            mid = sum(r.values()) / len(r) if p.boundary == "league_mean" else 1500.0
            r = {t: mid + p.keep * (v - mid) for t, v in r.items()}
        season = g["season"]
        for t in (g["home_team"], g["away_team"]):
            if t not in r:
                r[t] = 1500.0
            elif p.boundary == "team" and last[t] != season:
                r[t] = 1500.0 + p.keep * (r[t] - 1500.0)
            last[t] = season
        h, a = r[g["home_team"]], r[g["away_team"]]
        edge = h - a + (0 if g["neutral"] else p.home)
        e = 1 / (1 + 10 ** (-edge / 400))
        m = g["home_pts"] - g["away_pts"]
        s = p.k * ((1.0 if m > 0 else 0.0 if m < 0 else 0.5) - e)
        if p.mov:
            import math

            s *= math.log(abs(m) + 1) * 2.2 / (0.001 * (edge if m > 0 else -edge if m < 0 else 0.0) + 2.2)
        out[g["game_id"]] = (h, a)
        r[g["home_team"]], r[g["away_team"]] = h + s, a - s
    return out


@pytest.mark.parametrize("name", list(ratings.VARIANTS))
def test_elo_variants_by_hand(spark, name):
    gm, p = tiny_league(spark), ratings.VARIANTS[name]
    want = by_hand([r.asDict() for r in gm.orderBy("game_date", "game_id").collect()], p)
    for r in ratings.elo_replay(gm, p).collect():
        assert (r["home_elo"], r["away_elo"]) == pytest.approx(want[r["game_id"]], abs=1e-9)


def test_elo_does_not_depend_on_partitioning(spark):
    gm = views.decided(spark, SMALL)
    a = rows(ratings.elo_replay(gm, ratings.EloParams()), "game_id", "home_elo", "away_elo")
    b = rows(ratings.elo_replay(gm.repartition(17, "away_team"), ratings.EloParams()), "game_id", "home_elo", "away_elo")
    assert a == b


def test_grid_cell_equals_single_replay(spark):
    gm = views.decided(spark, SMALL)
    cells = ratings.grid_cells(ratings.EloParams(), [10.0, 30.0], [0.6], [0.0, 40.0])
    grid = {(r["league"], r["cell"], r["season"]): r["loss"] for r in ratings.elo_grid_losses(gm, cells, ["league"], chunk=3).collect()}
    one = ratings.with_elo(gm, cells[3])
    y = (F.col("home_pts") > F.col("away_pts")).cast("double")
    for r in one.groupBy("league", "season").agg(F.sum(ratings.log_loss_term(F.col("home_expected"), y)).alias("l")).collect():
        assert grid[(r["league"], 3, r["season"])] == pytest.approx(r["l"], abs=1e-9)


# ---- statistics ---------------------------------------------------------------------------------


def scored(spark, n=4000):
    return spark.range(n).select(F.col("id").alias("row_id"), (F.rand(1) * 0.8 + 0.1).alias("p"), F.rand(2).alias("u")).withColumn("y", (F.col("u") < F.col("p")).cast("int"))


def test_bin_edges_both_conventions(spark):
    df = frame(spark, [(0.0, 0), (0.1, 1), (0.1, 0), (0.2, 1), (1.0, 1)], "p double, y int")
    right = {r["bin"]: r["n"] for r in stats.calibration_bins(df, "y", "p").collect()}
    left = {r["bin"]: r["n"] for r in stats.calibration_bins(df, "y", "p", closed="left").collect()}
    assert right == {0: 3, 1: 1, 9: 1} and left == {0: 1, 1: 2, 2: 1, 9: 1}


def test_auc_is_rank_based_and_monotone_invariant(spark):
    df = scored(spark)
    a = stats.auc(df, "y", "p").first()["auc"]
    b = stats.auc(df.withColumn("p", F.col("p") * F.col("p")), "y", "p").first()["auc"]
    ref = [(r["p"], r["y"]) for r in df.collect()]
    pos, neg = [p for p, y in ref if y], [p for p, y in ref if not y]
    brute = sum((x > z) + 0.5 * (x == z) for x in pos for z in neg) / (len(pos) * len(neg))
    assert a == pytest.approx(brute, abs=1e-12) and a == pytest.approx(b, abs=1e-12)


def test_murphy_identity(spark):
    r = stats.brier_decomposition(scored(spark), "y", "p").first()
    assert r["brier_binned"] == pytest.approx(r["reliability"] - r["resolution"] + r["uncertainty"], abs=1e-12)


def test_per_row_loss_mean_is_the_metric(spark):
    df = scored(spark)
    m = stats.class_metrics(df, "y", "p").first()["log_loss"]
    assert df.agg(F.avg(stats.per_row_loss(F.col("y").cast("double"), F.col("p"), True))).first()[0] == pytest.approx(m, abs=1e-12)


def test_bootstrap_interval_has_the_right_width(spark):
    r = stats.bootstrap_mean(scored(spark).withColumn("x", F.col("y").cast("double")), "x", 400, 3).first()
    want = 1.96 * (r["mean"] * (1 - r["mean"]) / 4000) ** 0.5
    assert (r["hi"] - r["lo"]) / 2 == pytest.approx(want, rel=0.2)
    assert r["lo"] < r["mean"] < r["hi"]


def test_binomial_tail():
    from math import comb

    for n, k in ((10, 3), (25, 12), (1, 0), (0, 0), (400, 180)):
        want = min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)
        assert stats._binomial_two_sided(k, n) == pytest.approx(want, rel=1e-9)


def test_empirical_probability(spark):
    pool = frame(spark, [(-3.0,), (-1.0,), (0.5,), (2.0,)], "r double")
    df = frame(spark, [(1.0,), (-0.5,), (5.0,)], "m double")
    got = {r["m"]: r["empirical_p"] for r in stats.empirical_prob(df, "m", pool, "r").collect()}
    assert got[1.0] == pytest.approx(0.5) and got[-0.5] == pytest.approx(0.25) and got[5.0] == pytest.approx(1 - 1e-6)


def test_isotonic_has_no_inversions(spark):
    df = scored(spark)
    cal = modelling.apply_isotonic(modelling.fit_isotonic(df, "p", "y"), df, "p")
    assert stats.inversions(cal, "p", "calibrated").first()["inversions"] == 0


@pytest.mark.parametrize("classification", [True, False])
def test_early_stopping_waits_for_a_lower_loss(spark, classification):
    rng = random.Random(3)
    data = [(x := rng.random(), z := rng.random(), float(rng.random() < x * z + 0.2), i % 2 == 0) for i in range(240)]
    df = frame(spark, data, "a double, b double, y double, stop boolean").coalesce(1).persist()
    whole = modelling.fit_gbt(df.filter("NOT stop"), ["a", "b"], "y", classification, depth=1, trees=12)
    losses = modelling.staged_losses(whole, df.filter("stop"), classification)
    for patience in (1, 12):
        got = modelling.fit_gbt(df, ["a", "b"], "y", classification, depth=1, trees=12, early_stop="stop", patience=patience)
        want = modelling.stopping_point(losses, patience)
        assert want > 1 and modelling.staged_losses(got, df.filter("stop"), classification) == pytest.approx(losses[:want], abs=1e-9)


def test_boosted_winner_model_fits_every_cell(spark, monkeypatch):
    """Sixteen cells of four features, and a stopping season with the rates that eight trees lead to."""
    rates, led, data = [0.1 + 0.05 * (7 * k % 16) for k in range(16)], [], []
    for rate in rates:
        f = 2 * rate - 1
        for _ in range(7):
            f += 0.05 * 4 * (rate - 1 / (1 + exp(-2 * f)))
        led.append(1 / (1 + exp(-2 * f)))
    for k in range(16):
        x = [float(k >> b & 1) for b in range(4)]
        for season, rate in ((1997, rates[k]), (1998, led[k])):
            data += [(season, 1000 * k + i, *x, float(i < round(100 * rate))) for i in range(100)]
        data.append((1999, k, *x, 0.0))
    df = frame(spark, data, f"season int, game_id long, {', '.join(f'{c} double' for c in model_queries.FEATURES)}, home_win double").coalesce(1).persist()
    monkeypatch.setattr(model_queries, "model_table", lambda spark, sf_dir: df)
    got = {r.game_id: r.p_home for r in load()["boosted_winner_model"].build(spark, SMALL).collect()}
    assert sorted(got) == list(range(16)) and len(set(got.values())) == 16
    assert all(abs(got[k] - led[k]) < 0.01 for k in range(16))


# ---- plans --------------------------------------------------------------------------------------


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_rolling_columns_share_one_window_and_one_shuffle(spark):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    df = lines.selectExpr(
        "l_suppkey AS team", "l_linenumber AS season", "l_orderkey AS game_id", "CAST(l_shipdate AS DATE) AS game_date", "l_quantity AS pts", "l_tax AS opp_pts"
    )
    plan = plan_of(rolling.add_rolling(df, ["team", "season"], ["pts", "opp_pts"], [5, 10]))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_scan_reads_only_needed_columns(spark):
    df = files.scan_columns(spark, f"{SMALL}/lineitem.parquet", ["l_orderkey", "l_quantity"]).filter("l_quantity > 25")
    text = plan_of(df)
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text and "GreaterThan(l_quantity,25.0)" in text


def test_elo_sorts_once(spark):
    gm = tiny_league(spark)
    plan = plan_of(ratings.elo_replay(gm, ratings.EloParams()))
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1


def test_flagship(spark):
    df = game_features(spark, SMALL)
    assert df.count() == views.played(spark, SMALL).count()
    assert side_features(views.team_games(spark, SMALL)).count() == 2 * df.count()


def test_mirror_check_compares_values(spark):
    """Two level rows of different teams cancel in every sum."""
    rows = [("1", 1, 2, 10.0, 10.0, True), ("1", 4, 3, 20.0, 20.0, False), ("2", 1, 2, 7.0, 9.0, True), ("2", 2, 1, 9.0, 7.0, False)]
    df = spark.createDataFrame(rows, "game_id string, team int, opp int, pts double, opp_pts double, is_home boolean").withColumn("league", F.lit("x"))
    assert [r["game_id"] for r in quality.mirror_violations(df).collect()] == ["1"]


def test_stated_team_without_games_differs(spark):
    from pregame.operators import aggregates

    fields = ", ".join(f"{f} int" for f in aggregates.STANDING_FIELDS)
    computed = spark.createDataFrame([(1, 1, 0, 0, 3, 2)], f"team int, {fields}")
    stated = spark.createDataFrame([(1, 1, 0, 0, 3, None), (2, 1, 0, 0, 4, 1)], f"team int, {fields}")
    got = {r["team"]: [(x["field"], x["delta"]) for x in r["fields"]] for r in aggregates.standings_diff(computed, stated, ["team"]).collect()}
    assert got == {2: [("win", -1), ("gf", -4), ("ga", -1)]}


def test_gate_refuses_an_unknown_baseline(spark):

    rows = [("m", i, 0.5, 0.5, None) for i in range(20)]
    df = spark.createDataFrame(rows, "market string, row_id long, candidate double, production double, naive double")
    with pytest.raises(PySparkException, match="no-skill loss unknown"):
        modelling.promotion_gate(df, 2.0, 20).collect()


def test_scans_check_header_and_width(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(c, T.StringType() if c == "game_id" else T.DoubleType()) for c in ("game_id", "pts", "opp")])
    for name, text in {"good": "game_id,pts,opp\n1,2,3\n", "swapped": "game_id,opp,pts\n1,2,3\n", "wide": "game_id,pts,opp\n1,2,3,4\n", "short": "game_id,pts,opp\n1,2\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_text(text)
    assert files.scan_seasons(spark, str(tmp_path / "good"), schema).count() == 1
    assert files.scan_game_files(spark, str(tmp_path / "good"), ["game_id", "pts", "opp"]).first()["opp"] == "3"
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.scan_seasons(spark, str(tmp_path / "swapped"), schema).collect()
    for name in ("swapped", "wide", "short"):
        with pytest.raises((PySparkException, Py4JJavaError)):
            files.scan_game_files(spark, str(tmp_path / name), ["game_id", "pts", "opp"]).collect()
