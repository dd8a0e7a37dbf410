"""Data-quality gates. Each returns the violating rows or keys; an empty result is a pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pregame.functions.scalar import result_with_end, season_first_day, season_from_id, season_last_day

GAME = "game_id"

# ---- shape of files and columns -----------------------------------------------------------------


def header_mismatches(lines: DataFrame) -> DataFrame:
    """Files whose header differs from the most common one, with missing and extra columns.

    ``lines`` is a text scan with ``value`` and ``file``. The header is the first line of a file, found
    as the line at the least position; files are then grouped by header text.
    """
    head = lines.groupBy("file").agg(F.min_by("value", "pos").alias("header"))
    n = head.groupBy("header").agg(F.count(F.lit(1)).alias("files"))
    usual = n.agg(F.max_by("header", F.struct("files", "header")).alias("usual"))
    odd = head.crossJoin(F.broadcast(usual)).filter("header <> usual")  # one row
    cols, want = F.split("header", ","), F.split("usual", ",")
    return odd.select(
        "file", F.array_sort(F.array_except(want, cols)).alias("missing"), F.array_sort(F.array_except(cols, want)).alias("extra")
    )


def missing_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULLs per critical column, one pass; only columns that have some."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols])
    return one.select(F.explode(rows).alias("r")).select("r.*").filter("nulls > 0")


def date_problems(df: DataFrame, text: str, season: str, keep: list[str]) -> DataFrame:
    """Dates that do not parse and dates outside their season (September to August)."""
    d = F.col(text).try_cast("date")
    problem = F.when(d.isNull(), "unparseable").when(
        ~d.between(season_first_day(F.col(season)), season_last_day(F.col(season))), "outside season"
    )
    return df.select(*keep, season, text, problem.alias("problem")).filter("problem IS NOT NULL")


def wrong_season_ids(df: DataFrame, game_id: str, day: str, season: str) -> DataFrame:
    by_id = season_from_id(F.col(game_id), F.col(day))
    return df.withColumn("season_by_id", by_id).filter(~F.col("season_by_id").eqNullSafe(F.col(season)))


def domain_violations(df: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Values outside their domain: column, value, rows. NULL counts as outside."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), (~F.coalesce(F.col(c).isin(v), F.lit(False))).alias("bad"))
            for c, v in allowed.items()
        ]
    )
    return (
        df.select(F.explode(cells).alias("c"))
        .filter("c.bad")
        .groupBy("c.column", "c.value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


# ---- rows per game, duplicates, identity --------------------------------------------------------


def game_sides(tg: DataFrame, key: list[str] = [GAME]) -> DataFrame:  # noqa: B006
    """Games without exactly two rows of which one is home."""
    per = tg.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_home").alias("home_rows"))
    return per.filter("rows <> 2 OR home_rows <> 1")


def duplicate_rows(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def rows_per_game(box: DataFrame, low: int, high: int, teams: int = 2) -> DataFrame:
    """Implausible box scores: row count, number of teams, repeated players."""
    per = box.groupBy(GAME).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("team").alias("teams"),
        (F.count(F.lit(1)) - F.countDistinct("player_id")).alias("repeated"),
    )
    return per.filter((~F.col("rows").between(low, high)) | (F.col("teams") != teams) | (F.col("repeated") > 0))


def identity_conflicts(df: DataFrame, key: str, label: str, scope: list[str]) -> DataFrame:
    """Within a scope: an id with several labels, a label shared by several ids."""
    pairs = df.select(*scope, F.col(key).cast("string").alias("id"), F.col(label).alias("label")).distinct()
    many_labels = pairs.groupBy(*scope, "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    many_ids = pairs.groupBy(*scope, "label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    a = many_labels.select(*scope, F.lit("id with several labels").alias("problem"), F.col("id").alias("subject"), "n")
    b = many_ids.select(*scope, F.lit("label of several ids").alias("problem"), F.col("label").alias("subject"), "n")
    return a.unionByName(b)


def overlapping_id_ranges(df: DataFrame, league: str, key: str) -> DataFrame:
    """Leagues whose id ranges overlap: one aggregated row per league, compared with the next range reached so far."""
    span = df.groupBy(league).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    w = Window.orderBy("low", league).rowsBetween(Window.unboundedPreceding, -1)  # one row per league
    seen = span.withColumn("_reach", F.max(F.struct("high", league)).over(w))
    return seen.filter(F.col("_reach.high") >= F.col("low")).select(
        league, "low", "high", F.col(f"_reach.{league}").alias("overlaps"), F.col("_reach.high").alias("overlaps_to")
    )


def double_bookings(tg: DataFrame, keys: list[str]) -> DataFrame:
    """Teams with more than one game on a date (or in a week): key, count."""
    return tg.groupBy(*keys).agg(F.count(F.lit(1)).alias("games")).filter("games > 1")


# ---- results and margins ------------------------------------------------------------------------


def with_derived_margin(tg: DataFrame, stated: str) -> DataFrame:
    """Margin from the two scores; the stated value is kept beside it. NULL unless the game has two rows."""
    per = tg.groupBy(F.col(GAME).alias("_g")).agg(F.count(F.lit(1)).alias("_n"), F.sum("pts").alias("_s"))
    j = tg.join(per, F.col(GAME) == F.col("_g"), "left")
    margin = F.when(F.col("_n") == 2, 2 * F.col("pts") - F.col("_s"))
    return j.select(*[c for c in tg.columns if c != stated], margin.alias("margin"), F.col(stated).alias(f"{stated}_source"))


def margin_problems(df: DataFrame, stated: str) -> DataFrame:
    """Rows of :func:`with_derived_margin` that tie, contradict W/L or disagree with the source."""
    m, src = F.col("margin"), F.col(f"{stated}_source")
    problem = (
        F.when(m.isNull(), "no opponent row")
        .when(m == 0, "tie")
        .when((m > 0) != (F.col("wl") == "W"), "wl contradicts margin")
        .when(~m.eqNullSafe(src), "source disagrees")
    )
    return df.withColumn("problem", problem).filter("problem IS NOT NULL")


def unbalanced_margins(df: DataFrame, margin: str = "margin") -> DataFrame:
    return df.groupBy(GAME).agg(F.sum(margin).alias("margin_sum")).filter("margin_sum <> 0 OR margin_sum IS NULL")


def derived_margin_violations(df: DataFrame, margin: str) -> DataFrame:
    """A served margin column that is not the difference of the scores."""
    return df.filter(~F.col(margin).eqNullSafe(F.col("pts") - F.col("opp_pts")))


def irreconcilable_games(tg: DataFrame) -> DataFrame:
    """Games whose W/L contradicts the points, that tie, or that have not one winner and one loser."""
    order = F.struct("pts", "wl")
    per = tg.groupBy(GAME).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("pts").alias("low"),
        F.max("pts").alias("high"),
        F.count_if(F.col("wl") == "W").alias("winners"),
        F.max(order).alias("_top"),
    )
    problem = (
        F.when(F.col("rows") != 2, "not two rows")
        .when(F.col("low") == F.col("high"), "tied")
        .when(F.col("winners") != 1, "not one winner")
        .when(F.col("_top.wl") != "W", "wl contradicts points")
    )
    return per.select(GAME, "rows", "low", "high", "winners", problem.alias("problem")).filter("problem IS NOT NULL")


def mirror_violations(tg: DataFrame) -> DataFrame:
    """Games whose two rows do not mirror each other: teams, scores, home flags.

    The home row's values stand beside the away row's by conditional aggregates; no self join. Sums are reported only.
    """
    home, away = F.col("is_home"), ~F.col("is_home")
    values = ["team", "opp", "pts", "opp_pts"]
    per = tg.groupBy(GAME).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("pts") - F.col("opp_pts")).alias("margin_sum"),
        F.sum(F.col("team") - F.col("opp")).alias("team_sum"),
        F.count_if("is_home").alias("home_rows"),
        *(F.max(F.when(home, F.col(c))).alias(f"_h_{c}") for c in values),
        *(F.max(F.when(away, F.col(c))).alias(f"_a_{c}") for c in values),
    )
    mirrored = F.lit(True)
    for h, a in (("team", "opp"), ("opp", "team"), ("pts", "opp_pts"), ("opp_pts", "pts")):
        mirrored = mirrored & F.col(f"_h_{h}").eqNullSafe(F.col(f"_a_{a}"))
    return per.filter((F.col("rows") != 2) | (F.col("home_rows") != 1) | ~mirrored).select(GAME, "rows", "margin_sum", "team_sum", "home_rows")


def end_type_violations(df: DataFrame, result: str = "result") -> DataFrame:
    """Result not following from goals and end type; OT/SO margin not one; level score."""
    margin = F.abs(F.col("pts") - F.col("opp_pts"))
    expected = result_with_end(F.col("pts"), F.col("opp_pts"), F.col("game_end"))
    problem = (
        F.when(margin == 0, "level score")
        .when(F.col("game_end").isin("OT", "SO") & (margin != 1), "overtime margin is not one")
        .when(F.col(result) != expected, "result does not follow")
    )
    return df.withColumn("problem", problem).filter("problem IS NOT NULL")


def tie_violations(df: DataFrame) -> DataFrame:
    """``is_tie`` set without equal scores, or equal scores without it."""
    return df.filter(F.col("is_tie") != (F.col("pts") == F.col("opp_pts")))


def marker_violations(df: DataFrame, marker: str) -> DataFrame:
    """An independent outcome marker that disagrees with the score."""
    seen = F.when(F.col("pts") > F.col("opp_pts"), "W").when(F.col("pts") < F.col("opp_pts"), "L").otherwise("T")
    return df.filter(F.col(marker).isNotNull() & (F.col(marker) != seen))


def schedule_completeness(shape: DataFrame) -> DataFrame:
    """Seasons of :func:`aggregates.schedule_shape` that do not add up, incl. an odd shortfall."""
    return shape.filter(
        (~F.col("identity_holds"))
        | (~F.coalesce("reconciles", F.lit(True)))
        | ((F.col("verdict") == "short-only") & (F.col("shortfall") % 2 != 0))
    )


# ---- box scores and periods ---------------------------------------------------------------------


def box_total_mismatches(box: DataFrame, totals: DataFrame, on: list[str], col: str, total: str) -> DataFrame:
    """Sums of a box that differ from the stated total."""
    per = box.groupBy(*on).agg(F.sum(col).alias("box_sum"))
    return per.join(totals.select(*on, F.col(total).alias("stated")), on).filter(
        ~F.col("box_sum").eqNullSafe(F.col("stated"))
    )


def participation_conflicts(box: DataFrame, minutes: str, stats: list[str]) -> DataFrame:
    """Rows whose minutes and counting stats disagree about taking part."""
    has_stats = F.coalesce(*[F.col(s) for s in stats]).isNotNull()
    return box.filter(F.col(minutes).isNotNull() != has_stats)


def quarter_problems(df: DataFrame, quarters: list[str], final: str, max_overtime: int = 60) -> DataFrame:
    """Per row: quarters above the final, overtime by shortfall, implausible overtime, unreadable."""
    total: Column = F.lit(0.0)
    for q in quarters:
        total = total + F.col(q)
    gap = F.col(final) - total
    kind = (
        F.when(gap.isNull(), "unparseable")
        .when(gap < 0, "quarters exceed final")
        .when(gap > max_overtime, "implausible overtime")
        .when(gap > 0, "overtime")
        .otherwise("regulation")
    )
    return df.withColumns({"gap": gap, "kind": kind})


def overtime_agreement(by_score: DataFrame, by_minutes: DataFrame, games: DataFrame, low: float = 0.02, high: float = 0.12) -> DataFrame:
    """Overtime by two independent signals: both, one only, and whether the share is plausible."""
    both = (
        by_score.select(GAME, F.lit(1).alias("s"), F.lit(0).alias("m"))
        .unionByName(by_minutes.select(GAME, F.lit(0).alias("s"), F.lit(1).alias("m")))
        .groupBy(GAME)
        .agg(F.max("s").alias("s"), F.max("m").alias("m"))
    )
    n = games.agg(F.count(F.lit(1)).alias("games"))
    out = both.agg(
        F.count_if((F.col("s") == 1) & (F.col("m") == 1)).alias("both"),
        F.count_if((F.col("s") == 1) & (F.col("m") == 0)).alias("score_only"),
        F.count_if((F.col("s") == 0) & (F.col("m") == 1)).alias("minutes_only"),
    ).crossJoin(F.broadcast(n))  # one row
    share = (F.col("both") + F.col("score_only")) / F.col("games")
    return out.withColumns({"share": share, "plausible": share.between(low, high)})


def advanced_violations(adv: DataFrame, pace_tol: float = 0.05, net_tol: float = 0.15, points_tol: float = 2.0) -> DataFrame:
    """Team-games whose pace differs from the opponent's, net is not off - def, or implied points miss the score."""
    pace = adv.groupBy(F.col(GAME).alias("_g")).agg((F.max("pace") - F.min("pace")).alias("_spread"))
    j = adv.join(pace, F.col(GAME) == F.col("_g")).drop("_g")
    problem = (
        F.when(F.col("_spread") > pace_tol, "pace differs")
        .when(F.abs(F.col("net") - (F.col("off") - F.col("def"))) > net_tol, "net is not off - def")
        .when(F.abs(F.col("off") * F.col("possessions") / 100.0 - F.col("pts")) > points_tol, "implied points")
    )
    return j.withColumn("problem", problem).filter("problem IS NOT NULL").drop("_spread")


def period_problems(df: DataFrame, first: str, half: str, max_first: float, max_half: float) -> DataFrame:
    """Counts of NULL, negative, half below first period, implausible: one pass, one row."""
    q, h = F.col(first), F.col(half)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(q.isNull() | h.isNull()).alias("nulls"),
        F.count_if((q < 0) | (h < 0)).alias("negative"),
        F.count_if(h < q).alias("half_below_period"),
        F.count_if((q > max_first) | (h > max_half)).alias("implausible"),
    )


# ---- features -----------------------------------------------------------------------------------


def linear_identity(df: DataFrame, total: str, parts: list[str], tol: float = 1e-9) -> DataFrame:
    """Rows where a total column is not the sum of its parts (both NULL is fine)."""
    s: Column = F.col(parts[0])
    for p in parts[1:]:
        s = s + F.col(p)
    off = F.abs(F.col(total) - s) >= tol
    return df.filter(F.coalesce(off, F.col(total).isNull() != s.isNull()))


def constant_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns with at most one value (min = max): partial aggregates instead of distinct sets."""
    one = df.agg(
        *[F.min(c).cast("string").alias(f"_lo_{c}") for c in cols], *[F.max(c).cast("string").alias(f"_hi_{c}") for c in cols]
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"_lo_{c}").alias("lo"), F.col(f"_hi_{c}").alias("hi")) for c in cols]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*").filter("lo <=> hi")


def nulls_beyond_warmup(df: DataFrame, col: str, prior: str, w: int) -> DataFrame:
    """NULL windows on rows that already had ``w`` games."""
    return df.filter(F.col(col).isNull() & (F.col(prior) >= w))


def row_count_change(before: DataFrame, after: DataFrame, factor: int = 1) -> DataFrame:
    """One row: counts and whether a step kept ``factor`` rows per row."""
    a = before.agg(F.count(F.lit(1)).alias("rows_before"))
    b = after.agg(F.count(F.lit(1)).alias("rows_after"))
    return a.crossJoin(F.broadcast(b)).withColumn(  # one row each
        "preserved", F.col("rows_after") == F.col("rows_before") * factor
    )


def label_violations(gm: DataFrame, leagues: list[str]) -> DataFrame:
    """Label against margin sign, ties, rows of a competition that does not belong."""
    problem = (
        F.when(~F.col("league").isin(leagues), "foreign competition")
        .when(F.col("margin") == 0, "tie")
        .when(F.col("home_win") != (F.col("margin") > 0).cast("int"), "label contradicts margin")
    )
    return gm.withColumn("problem", problem).filter("problem IS NOT NULL")


def routing_violations(routed: DataFrame, features: list[str]) -> DataFrame:
    """Rows routed to the linear model that lack a feature."""
    missing = F.lit(False)
    for c in features:
        missing = missing | F.col(c).isNull()
    return routed.filter((F.col("route") == "linear") & missing)


def routing_counts(routed: DataFrame, recorded: dict[str, int]) -> DataFrame:
    """Routed counts beside the recorded ones."""
    per = routed.groupBy("route").agg(F.count(F.lit(1)).alias("rows"))
    want: Column | None = None
    for k, v in recorded.items():
        want = F.when(F.col("route") == k, v) if want is None else want.when(F.col("route") == k, v)
    return per.withColumn("recorded", want).withColumn("matches", F.col("rows").eqNullSafe(F.col("recorded")))


def differing_windows(df: DataFrame, a: str, b: str, where: Column) -> DataFrame:
    """Rows on which two window candidates differ although they must agree."""
    return df.filter(where & ~F.col(a).eqNullSafe(F.col(b)))


def value_changes(old: DataFrame, new: DataFrame, keys: list[str], col: str, tol: float = 1e-9) -> DataFrame:
    """Keys whose value moved by ``tol`` or more, or appeared or vanished."""
    j = old.select(*keys, F.col(col).alias("old")).join(new.select(*keys, F.col(col).alias("new")), keys, "full")
    moved = F.coalesce(F.abs(F.col("old") - F.col("new")) >= tol, F.col("old").isNull() != F.col("new").isNull())
    return j.filter(moved)


# ---- leakage harness ----------------------------------------------------------------------------


def corruption_effect(
    df: DataFrame, feature: Callable[[DataFrame], DataFrame], keys: list[str], col: str, poison: Column, column: str, target: Column
) -> DataFrame:
    """Target rows whose feature moves when ``column`` is poisoned on the ``poison`` rows.

    Poisoning later rows (or another group) must return nothing; poisoning earlier rows must not.
    """
    bad = df.withColumn(column, F.when(poison, F.col(column) * 1000 + 12345).otherwise(F.col(column)))
    return value_changes(feature(df).filter(target), feature(bad).filter(target), keys, col)


def truncation_differences(
    stored: DataFrame, rebuilt: DataFrame, keys: list[str], cols: list[str], tol: float = 1e-9
) -> DataFrame:
    """Stored features against those rebuilt from strictly earlier history; both NULL is equal."""
    r = rebuilt.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in cols])
    j = stored.join(r, keys)
    parts = []
    for c in cols:
        a, b = F.col(c), F.col(f"_r_{c}")
        moved = F.coalesce(F.abs(a - b) > tol * (1 + F.abs(b)), a.isNull() != b.isNull())
        parts.append(F.when(moved, F.struct(F.lit(c).alias("column"), a.alias("stored"), b.alias("rebuilt"))))
    diff = F.array_compact(F.array(*parts))
    return j.select(*keys, F.explode(diff).alias("d")).select(*keys, "d.*")


def exception_drift(listed: DataFrame, failing: DataFrame, keys: list[str]) -> DataFrame:
    """Listed exceptions that no longer fail (stale) and failures that are not listed (unlisted)."""
    from pregame.operators.joins import key_coverage

    out = key_coverage(failing, listed, keys)
    return out.withColumn("coverage", F.when(F.col("coverage") == "extra", "stale").otherwise("unlisted"))


def planted(clean: DataFrame, corrupt: DataFrame, keys: list[str]) -> DataFrame:
    """A corrupted copy, refused when the plant changed nothing."""
    changed = corrupt.exceptAll(clean).take(1) or clean.exceptAll(corrupt).take(1)
    if not changed:
        raise ValueError("the plant changed no row")
    return corrupt


def examples_for(problems: DataFrame, k: int = 5) -> DataFrame:
    from pregame.operators.sets import examples

    return examples(problems, ["problem"], GAME, k)
