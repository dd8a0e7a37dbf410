"""Checked, self, as-of-season and entity joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pregame.functions.scalar import pair_key


def duplicate_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def join_checked(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    cardinality: str = "many_to_one",
    on_unmatched: str = "keep",
) -> DataFrame:
    """Left join that cannot multiply rows.

    The right keys (both sides' for ``one_to_one``) must be unique. ``matched`` marks the partner;
    ``on_unmatched`` is keep, drop or fail (checked while the plan runs, without a second pass).
    """
    checks = {"many_to_one": [right], "one_to_one": [left, right], "one_to_many": [left]}[cardinality]
    for side in checks:
        bad = duplicate_keys(side, on).take(1)
        if bad:
            raise ValueError(f"join on {on} is not {cardinality}: {bad[0].asDict()}")
    marked = right.withColumn("matched", F.lit(True))
    out = left.join(marked, on, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    if on_unmatched == "drop":
        return out.filter("matched")
    if on_unmatched == "fail":
        text = F.concat_ws(",", *[F.col(c).cast("string") for c in on])
        guard = F.when(F.col("matched"), True).otherwise(F.raise_error(F.concat(F.lit("no partner for "), text)))
        return out.withColumn("matched", guard)
    return out


def join_with_known_gaps(left: DataFrame, right: DataFrame, on: list[str], known: DataFrame, game: str = "game_id"):
    """(joined, problems): every unmatched game must be listed, and both its sides must be missing."""
    joined = left.join(right.withColumn("matched", F.lit(True)), on, "left")
    per_game = joined.groupBy(game).agg(
        F.count_if(F.col("matched").isNull()).alias("missing"), F.count(F.lit(1)).alias("rows")
    )
    gaps = per_game.filter("missing > 0")
    listed = known.select(game).distinct().withColumn("listed", F.lit(True))
    problems = (
        gaps.join(listed, game, "left")
        .withColumn(
            "problem",
            F.when(F.col("listed").isNull(), "not listed").when(F.col("missing") != F.col("rows"), "one side only"),
        )
        .filter("problem IS NOT NULL")
        .select(game, "missing", "problem")
    )
    return joined.withColumn("matched", F.coalesce("matched", F.lit(False))), problems


def attach_opponent(tg: DataFrame, cols: list[str], game: str = "game_id") -> DataFrame:
    """``opp_{col}`` for numeric columns: the game's sum minus the own value.

    Games are aggregated first (map-side combined) and joined back, so a repeated game id neither
    gathers in one task nor multiplies rows. NULL unless the game has exactly two rows.
    """
    agg = [F.sum(c).alias(f"_s_{c}") for c in cols] + [F.count(c).alias(f"_n_{c}") for c in cols]
    per = tg.groupBy(F.col(game).alias("_game")).agg(F.count(F.lit(1)).alias("_rows"), *agg)
    out = tg.join(per, F.col(game) == F.col("_game"), "left")
    new = {}
    for c in cols:
        new[f"opp_{c}"] = F.when((F.col("_rows") == 2) & (F.col(f"_n_{c}") == 2), F.col(f"_s_{c}") - F.col(c))
    return out.select(*tg.columns, *[v.alias(k) for k, v in new.items()])


def attach_opponent_label(tg: DataFrame, col: str, game: str = "game_id") -> DataFrame:
    """The other row's label; NULL when the game has not exactly two rows."""
    per = tg.groupBy(F.col(game).alias("_game")).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(col).alias("_lo"), F.max(col).alias("_hi")
    )
    other = F.when(F.col(col) == F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo"))
    out = tg.join(per, F.col(game) == F.col("_game"), "left")
    return out.select(*tg.columns, F.when(F.col("_rows") == 2, other).alias(f"opp_{col}"))


def to_game_rows(tg: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """One wide row per game from its home and away row: one aggregate, no self join.

    Games without exactly one home and one away row are left out, as by an inner 1:1 join.
    """
    home, away = F.col("is_home"), ~F.col("is_home")
    # max() over a one-row side returns that row's value; NULLs stay NULL.
    vals = [F.max(F.when(home, F.col(c))).alias(f"home_{c}") for c in cols]
    vals += [F.max(F.when(away, F.col(c))).alias(f"away_{c}") for c in cols]
    out = tg.groupBy(*keys).agg(F.count_if(home).alias("_h"), F.count_if(away).alias("_a"), *vals)
    return out.filter("_h = 1 AND _a = 1").drop("_h", "_a")


def reindex_to_universe(universe: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Every universe row, with NULL facts where there are none, ready for windows."""
    return universe.join(facts, keys, "left")


def attach_game_date(df: DataFrame, games: DataFrame, game: str = "game_id") -> DataFrame:
    """Date per row; a game id without a date is fatal."""
    dim = games.groupBy(game).agg(F.min("game_date").alias("game_date"))
    out = df.join(dim, game, "left")
    guard = F.when(F.col("game_date").isNotNull(), F.col("game_date")).otherwise(
        F.raise_error(F.concat(F.lit("no date for game "), F.col(game).cast("string"))).cast("date")
    )
    return out.withColumn("game_date", guard)


def identity_as_of(df: DataFrame, identity: DataFrame, key: str = "team", season: str = "season") -> DataFrame:
    """Name valid in the row's season; NULL bounds are open. Equi-join on the key, range as residual."""
    ident = identity.withColumnRenamed(key, "_key")
    cond = (
        (F.col(key) == F.col("_key"))
        & (F.coalesce(F.col("first_season"), F.lit(-9999)) <= F.col(season))
        & (F.col(season) <= F.coalesce(F.col("last_season"), F.lit(9999)))
    )
    return df.join(ident, cond, "left").drop("_key", "first_season", "last_season")


def key_coverage(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys missing from ``found`` and extra in it, in one pass over both."""
    both = (
        expected.select(*keys, F.lit(1).alias("_e"), F.lit(0).alias("_f"))
        .unionByName(found.select(*keys, F.lit(0).alias("_e"), F.lit(1).alias("_f")))
        .groupBy(*keys)
        .agg(F.max("_e").alias("_e"), F.max("_f").alias("_f"))
    )
    side = F.when(F.col("_f") == 0, "missing").when(F.col("_e") == 0, "extra")
    return both.withColumn("coverage", side).filter("coverage IS NOT NULL").drop("_e", "_f")


def market_agreement(a: DataFrame, b: DataFrame, near: float = 0.02) -> DataFrame:
    """Shared games, opposite picks, and opposite picks where the first is near a coin flip."""
    j = a.select("game_id", F.col("p_home").alias("_a")).join(
        b.select("game_id", F.col("p_home").alias("_b")), "game_id"
    )
    opposite = (F.col("_a") > 0.5) != (F.col("_b") > 0.5)
    return j.agg(
        F.count(F.lit(1)).alias("shared"),
        F.count_if(opposite).alias("disagree"),
        F.count_if(opposite & (F.abs(F.col("_a") - 0.5) <= near)).alias("disagree_near_half"),
    )


def common_rows(df: DataFrame, candidates: dict[str, list[str]], target: str) -> DataFrame:
    """Rows every candidate's features can score."""
    need = sorted({c for cols in candidates.values() for c in cols} | {target})
    return df.dropna(subset=need)


def enrich_fixtures(fx: DataFrame, teams: DataFrame) -> DataFrame:
    """Names of both sides in one pass."""
    t = teams.select("team", "name")
    h = t.select(F.col("team").alias("_h"), F.col("name").alias("home_name"))
    a = t.select(F.col("team").alias("_a"), F.col("name").alias("away_name"))
    return (
        fx.join(h, F.col("home_team") == F.col("_h"), "left")
        .join(a, F.col("away_team") == F.col("_a"), "left")
        .drop("_h", "_a")
    )


def latest_prediction(pred: DataFrame, key: str = "game_id", at: str = "predicted_at", tie: list[str] | None = None) -> DataFrame:
    """The newest row per game: a struct maximum, combined map-side."""
    rest = [c for c in pred.columns if c != key]
    order = F.struct(at, *(tie or []))
    best = pred.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(key, "r.*").select(*pred.columns)


def cross_grid(games: DataFrame, grid: list[dict]) -> DataFrame:
    """Rows times parameter cells. The grid is a literal array, exploded: no join, no shuffle."""
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("cell"), *[F.lit(v).alias(k) for k, v in g.items()])
            for i, g in enumerate(grid)
        ]
    )
    return games.select("*", F.explode(cells).alias("_c")).select(*games.columns, "_c.*")


def align(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """Full outer alignment of one-row-per-key frames: union then one aggregate, a single shuffle."""
    cols = {c: t for f in frames for c, t in f.dtypes if c not in key}
    parts = []
    for f in frames:
        parts.append(f.select(*key, *[(F.col(c) if c in f.columns else F.lit(None).cast(t)).alias(c) for c, t in cols.items()]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*key).agg(*[F.max(c).alias(c) for c in cols])


def replace_by_lookup(df: DataFrame, key: str, lookup: DataFrame, col: str) -> DataFrame:
    """``col`` replaced by the looked-up value; a key without one is fatal."""
    look = lookup.select(F.col(key).alias("_k"), F.col(col).alias("_v"))
    out = df.drop(col).join(look, F.col(key) == F.col("_k"), "left")
    v = F.when(F.col("_v").isNull(), F.raise_error(F.concat(F.lit("no value for "), F.col(key).cast("string")))).otherwise(
        F.col("_v")
    )
    return out.withColumn(col, v).drop("_k", "_v")


def match_entities(report: DataFrame, roster: DataFrame) -> DataFrame:
    """(team, name) first, then a name that only one roster row carries; unmatched rows stay.

    ``roster`` has unique (team, name). Both stages are equi-joins to aggregated keys.
    """
    exact = roster.select(F.col("team").alias("_t"), F.col("name").alias("_n"), F.col("player_id").alias("_p1"))
    unique = (
        roster.groupBy(F.col("name").alias("_un"))
        .agg(F.count(F.lit(1)).alias("_c"), F.min("player_id").alias("_p2"))
        .filter("_c = 1")
        .drop("_c")
    )
    out = report.join(exact, (F.col("team") == F.col("_t")) & (F.col("name") == F.col("_n")), "left").join(
        unique, F.col("name") == F.col("_un"), "left"
    )
    kind = F.when(F.col("_p1").isNotNull(), "team_and_name").when(F.col("_p2").isNotNull(), "unique_name")
    return out.select(
        *report.columns,
        F.coalesce("_p1", "_p2").alias("player_id"),
        F.coalesce(kind, F.lit("unmatched")).alias("match_kind"),
    )


def group_copies(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Copies of one game: same keys and unordered pair of teams."""
    return rows.groupBy(*keys, pair_key(F.col("home_team"), F.col("away_team")).alias("pair")).agg(
        F.count(F.lit(1)).alias("copies"), F.countDistinct("copy_away").alias("scores")
    )


def match_boxes(games: DataFrame, boxes: DataFrame, block: list[str], game_name: str, box_name: str) -> DataFrame:
    """Boxes to games of the same block whose name ends with the box's short name.

    Every suffix of a game's name becomes a row, so the match is an equality on block and suffix: a busy
    block costs its names' letters, not the pairs of its games and boxes. A blank short name matches nothing.
    """
    n = F.length(game_name)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col(game_name), i, n))
    g = games.withColumn("_suffix", F.explode(F.when(n > 0, suffixes)))
    named = F.col(box_name) != ""
    b = boxes.filter(named).select(
        *[F.col(c).alias("_b_" + c) for c in block], F.col(box_name).alias("_short"), *[c for c in boxes.columns if c not in block]
    )
    cond = F.col("_suffix") == F.col("_short")
    for c in block:
        cond = cond & (F.col(c) == F.col("_b_" + c))
    return g.join(b, cond).drop("_suffix", "_short", *["_b_" + c for c in block])


def resolve_aliases(df: DataFrame, label: str, exact: DataFrame, aliases: DataFrame, malformed: DataFrame) -> DataFrame:
    """Label to franchise: valid name, then alias, then a listed malformed cell; anything else is fatal.

    Each table has a unique ``label`` and a ``franchise_id``; ``malformed`` also has a ``note``.
    """
    out = df
    for i, t in enumerate((exact, aliases, malformed)):
        cols = [F.col("label").alias(f"_l{i}"), F.col("franchise_id").alias(f"_f{i}")]
        if i == 2:
            cols.append(F.col("note"))
        out = out.join(t.select(*cols), F.col(label) == F.col(f"_l{i}"), "left")
    found = F.coalesce("_f0", "_f1", "_f2")
    fid = F.when(found.isNull(), F.raise_error(F.concat(F.lit("unknown label "), F.col(label)))).otherwise(found)
    how = F.when(F.col("_f0").isNotNull(), "name").when(F.col("_f1").isNotNull(), "alias").otherwise("malformed")
    note = F.when(how == "malformed", F.col("note"))
    return out.select(*df.columns, fid.alias("franchise_id"), how.alias("resolved_by"), note.alias("note"))




def null_list(cols: list[str]) -> Column:
    """Names of the NULL columns of a row."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]))
