"""Pairing two copies of each game, standings reconciliation and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pregame.functions.scalar import pair_key
from pregame.operators.aggregates import STANDING_FIELDS, modal_by_group
from pregame.session import cut_lineage

# ---- pairing ------------------------------------------------------------------------------------


def pair_copies(rows: DataFrame, scope: list[str], day: str = "copy_date", tie: str = "game_id") -> DataFrame:
    """Copies A and B of a game paired on the unordered teams and a date at most one day apart.

    Greedy in date order, each row used once; rows without a twin stay single. ``slot`` is equal on
    both rows of a pair and NULL on singles.

    Which row meets which depends only on how many copies of each kind a day has and how many were
    left over the day before. So days are counted per pair of teams, the leftover is carried through a
    run of consecutive days by an array fold over those counts, and every row finds its slot from its
    rank within (pair, day, copy). No group of rows is gathered.
    """
    keys = [*scope, "pair"]
    r = rows.withColumn("pair", pair_key(F.col("home_team"), F.col("away_team")))
    per_day = r.groupBy(*keys, F.unix_date(day).alias("_d")).agg(
        F.count_if(F.col("copy") == "A").cast("int").alias("a"), F.count_if(F.col("copy") == "B").cast("int").alias("b")
    )
    w = Window.partitionBy(*keys).orderBy("_d")
    runs = per_day.withColumn("_new", F.coalesce((F.col("_d") - F.lag("_d").over(w) > 1).cast("int"), F.lit(1))).withColumn(
        "_run", F.sum("_new").over(w)
    )
    seq = runs.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct("_d", "a", "b"))).alias("days"))
    # left > 0: that many A rows wait; left < 0: that many B rows wait.
    start = F.struct(F.lit(0).alias("left"), F.array().cast("array<struct<d:int,carry:int,left:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        carry = acc["left"]
        a = x["a"] - F.least(F.greatest(-carry, F.lit(0)), x["a"])
        b = x["b"] - F.least(F.greatest(carry, F.lit(0)), x["b"])
        entry = F.struct(x["_d"].alias("d"), carry.cast("int").alias("carry"), (a - b).cast("int").alias("left"))
        return F.struct((a - b).cast("int").alias("left"), F.concat(acc["out"], F.array(entry)).alias("out"))

    flow = seq.select(*keys, "days", F.explode(F.aggregate("days", start, step, lambda acc: acc["out"])).alias("f"))
    nxt = F.filter("days", lambda x: x["_d"] == F.col("f.d") + 1)
    flow = flow.select(
        *keys,
        F.col("f.d").alias("_d"),
        F.col("f.carry").alias("_carry"),
        F.col("f.left").alias("_left"),
        F.coalesce(F.get(nxt, F.lit(0))["a"], F.lit(0)).alias("_next_a"),
        F.coalesce(F.get(nxt, F.lit(0))["b"], F.lit(0)).alias("_next_b"),
    ).join(per_day, [*keys, "_d"])
    rank = F.row_number().over(Window.partitionBy(*keys, "_d", "copy").orderBy(tie))
    ranked = r.withColumn("_d", F.unix_date(day)).withColumn("_r", rank)
    j = ranked.join(flow, [*keys, "_d"])
    is_a = F.col("copy") == "A"
    own = F.when(is_a, F.col("a")).otherwise(F.col("b"))
    used = F.when(is_a, F.greatest(-F.col("_carry"), F.lit(0))).otherwise(F.greatest(F.col("_carry"), F.lit(0)))
    used_own = F.least(used, own)
    used_other = F.least(
        F.when(is_a, F.greatest(F.col("_carry"), F.lit(0))).otherwise(F.greatest(-F.col("_carry"), F.lit(0))),
        F.when(is_a, F.col("b")).otherwise(F.col("a")),
    )
    other_left = F.when(is_a, F.col("b")).otherwise(F.col("a")) - used_other
    q = F.col("_r") - used_own
    same = F.least(own - used_own, other_left)
    over = q - same
    waiting = F.when(is_a, F.col("_next_b")).otherwise(F.col("_next_a"))
    slot = (
        F.when(F.col("_r") <= used_own, F.concat_ws(":", (F.col("_d") - 1).cast("string"), F.lit("next"), F.col("_r").cast("string")))
        .when(q <= same, F.concat_ws(":", F.col("_d").cast("string"), F.lit("same"), q.cast("string")))
        .when(over <= waiting, F.concat_ws(":", F.col("_d").cast("string"), F.lit("next"), over.cast("string")))
    )
    return j.select(*rows.columns, "pair", slot.alias("slot"))


def paired_games(paired: DataFrame, scope: list[str], values: list[str]) -> DataFrame:
    """One row per pair or single: both copies' values side by side."""
    single = F.coalesce("slot", F.concat_ws(":", F.lit("single"), F.col("copy"), F.col("game_id").cast("string")))
    a, b = F.col("copy") == "A", F.col("copy") == "B"
    return paired.groupBy(*scope, "pair", single.alias("slot")).agg(
        F.count(F.lit(1)).alias("copies"),
        *[F.max(F.when(a, F.col(v))).alias(f"a_{v}") for v in values],
        *[F.max(F.when(b, F.col(v))).alias(f"b_{v}") for v in values],
    )


def copy_agreement(pairs: DataFrame, compare: list[str], open_season: Column) -> DataFrame:
    """agreed / quarantined (open season) / fatal (closed season) / single."""
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    verdict = (
        F.when(F.col("copies") < 2, "single")
        .when(same, "agreed")
        .when(open_season, "quarantined")
        .otherwise("fatal")
    )
    return pairs.withColumn("verdict", verdict)


def left_quarantine(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows quarantined by the last build and no longer: they moved into the table."""
    return previous.join(current.select(*keys), keys, "left_anti")


def settle_end(pairs: DataFrame) -> DataFrame:
    """End type of two agreeing copies: the home copy (A) wins an OT/SO dispute, which is marked."""
    a, b = F.col("a_game_end"), F.col("b_game_end")
    disputed = (a != b) & a.isin("OT", "SO") & b.isin("OT", "SO")
    return pairs.withColumns({"game_end": F.coalesce(a, b), "end_disputed": F.coalesce(disputed, F.lit(False))})


# ---- standings ----------------------------------------------------------------------------------

RESULT_FIELDS, GOAL_FIELDS = ["win", "loss", "otl"], ["gf", "ga"]


def delta_shape(diffs: DataFrame) -> DataFrame:
    """Shape of each team's computed-minus-stated difference (columns ``d_{field}``).

    score_only: goals differ, results agree. result_label: results cancel, goals agree. games_missing:
    every difference negative. mixed: anything else.
    """
    results = sum((F.when(F.col(f"d_{f}") != 0, 1).otherwise(0) for f in RESULT_FIELDS), F.lit(0))
    goals = sum((F.when(F.col(f"d_{f}") != 0, 1).otherwise(0) for f in GOAL_FIELDS), F.lit(0))
    balance = sum((F.col(f"d_{f}") for f in RESULT_FIELDS), F.lit(0))
    positive = sum((F.when(F.col(f"d_{f}") > 0, 1).otherwise(0) for f in STANDING_FIELDS), F.lit(0))
    shape = (
        F.when((results == 0) & (goals > 0), "score_only")
        .when((results > 0) & (goals == 0) & (balance == 0), "result_label")
        .when(positive == 0, "games_missing")
        .otherwise("mixed")
    )
    return diffs.withColumn("shape", shape)


def season_class(shapes: DataFrame, seasons: DataFrame, conflicts: DataFrame, incomplete: DataFrame, scope: list[str]) -> DataFrame:
    """One class per season by fixed priority: self_inconsistent, probable_error, incomplete, lag, reconciled."""
    s = shapes.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("_teams"), F.count_if(F.col("shape") != "games_missing").alias("_suspect")
    )
    c = conflicts.select(*scope).distinct().withColumn("_conflict", F.lit(True))
    i = incomplete.select(*scope).distinct().withColumn("_incomplete", F.lit(True))
    j = seasons.select(*scope).distinct().join(s, scope, "left").join(c, scope, "left").join(i, scope, "left")
    cls = (
        F.when(F.col("_conflict"), "self_inconsistent")
        .when((F.col("_suspect") > 0) | (F.col("_teams") == 1), "probable_error")
        .when(F.col("_incomplete"), "incomplete")
        .when(F.col("_teams") > 1, "lag")
        .otherwise("reconciled")
    )
    return j.select(*scope, cls.alias("season_class"), F.coalesce("_teams", F.lit(0)).alias("flagged_teams"))


def standings_coverage(stated: DataFrame, teams: DataFrame, keys: list[str]) -> DataFrame:
    """Teams missing from the page, extra on it, or without goals."""
    from pregame.operators.joins import key_coverage

    cover = key_coverage(teams, stated, keys).withColumnRenamed("coverage", "problem")
    bare = stated.filter(F.col("gf").isNull() | F.col("ga").isNull()).select(*keys, F.lit("no goals").alias("problem"))
    return cover.unionByName(bare)


def field_conflicts(triples: DataFrame, scope: list[str]) -> DataFrame:
    """Fields stated with several values: (scope, field, team), the values, and whether one template repeats itself."""
    per = triples.groupBy(*scope, "field", "team").agg(
        F.count_distinct("value").alias("n"),
        F.array_sort(F.collect_set("value")).alias("values"),
        F.count_distinct("template").alias("_t"),
    )
    return per.filter("n > 1").select(
        *scope, "field", "team", "values", F.when(F.col("_t") == 1, "within").otherwise("between").alias("conflict")
    )


def settled_fields(triples: DataFrame, scope: list[str]) -> DataFrame:
    """Stated value per field; NULL where the page contradicts itself."""
    per = triples.groupBy(*scope, "field", "team").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return per.select(*scope, "field", "team", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("value"))


def localise_label(shapes: DataFrame, games: DataFrame, scope: list[str]) -> DataFrame:
    """The OT/SO games that may explain a result-label difference, named when there is exactly one.

    When the OTL count moved only games the team lost qualify. Candidates are counted by an aggregate.
    """
    flagged = shapes.filter(F.col("shape") == "result_label").select(*scope, "team", "d_otl")
    late = games.filter(F.col("game_end").isin("OT", "SO"))
    loser = F.when(F.col("home_pts") > F.col("away_pts"), F.col("away_team")).otherwise(F.col("home_team"))
    sides = late.select(*scope, "game_id", loser.alias("_loser"), F.explode(F.array("home_team", "away_team")).alias("team"))
    j = flagged.join(sides, [*scope, "team"], "left").filter(
        F.col("game_id").isNull() | (F.col("d_otl") == 0) | (F.col("_loser") == F.col("team"))
    )
    per = j.groupBy(*scope, "team").agg(F.count("game_id").alias("candidates"), F.min("game_id").alias("_g"))
    found = flagged.select(*scope, "team").join(per, [*scope, "team"], "left")
    n = F.coalesce("candidates", F.lit(0))
    return found.select(*scope, "team", n.alias("candidates"), F.when(n == 1, F.col("_g")).alias("localised_game"))


# ---- repair -------------------------------------------------------------------------------------


def components(edges: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, team, label): teams joined by edges share the least team of their component.

    Labels shrink to the neighbours' minimum and then jump to the label of their label, until no label
    moves. Each round is cut by a reliable checkpoint, so neither plan nor recovery grows.
    """
    both = edges.select(*scope, F.col("home_team").alias("u"), F.col("away_team").alias("v"))
    both = cut_lineage(both.unionByName(both.select(*scope, F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_lineage(both.groupBy(*scope, F.col("u").alias("team")).agg(F.least(F.first("u"), F.min("v")).alias("label")))
    while True:
        near = (
            both.join(labels.select(*scope, F.col("team").alias("v"), F.col("label").alias("_l")), [*scope, "v"])
            .groupBy(*scope, F.col("u").alias("team"))
            .agg(F.min("_l").alias("_near"))
        )
        step = labels.join(near, [*scope, "team"]).withColumn("new", F.least("label", "_near"))
        jump = step.select(*scope, F.col("team").alias("new"), F.col("new").alias("_far"))
        step = step.join(jump, [*scope, "new"], "left").select(
            *scope, "team", "label", F.least("new", F.coalesce("_far", F.col("new"))).alias("new")
        )
        step = cut_lineage(step)
        changed = step.filter("new < label").take(1)
        labels = step.select(*scope, "team", F.col("new").alias("label"))
        if not changed:
            return labels


def _effect(home: Column, away: Column, end: Column) -> tuple[Column, Column]:
    """(home, away) contributions to win, loss, otl, gf, ga of one reading of a game."""

    def vec(own: Column, other: Column) -> Column:
        win = (own > other).cast("int")
        reg = (end == "REG").cast("int")
        lost = (own < other).cast("int")
        return F.array(win, lost * reg, lost * (1 - reg), own.cast("int"), other.cast("int"))

    return vec(home, away), vec(away, home)


def _with_reach(halved: DataFrame, asked: DataFrame, shared: Column, ckeys: list[str]) -> DataFrame:
    """Adds to each suspect, for either team, the least and most per field that the suspects undecided after it can give the team.

    Undecided are the later ones of the half and all of the other half. The second half counts a shared team from nothing, so its
    need is taken off there. No bound (null) for a team with an unknown effect.
    """
    side = lambda team, x, role: F.struct(F.col(team).alias("team"), F.lit(role).alias("role"), *[F.col("options")[k][x].alias(o) for k, o in enumerate("pq")])
    # a game of a team against itself counts as its home game
    sides = halved.select(*ckeys, "half", "i", F.explode(F.array(side("home_team", "h", "home"), side("away_team", "a", "away"))).alias("x"), (F.col("home_team") == F.col("away_team")).alias("_own"))
    sides = sides.filter(~(F.coalesce("_own", F.lit(False)) & (F.col("x.role") == "away"))).select(*ckeys, "half", "i", "x.*")
    whole = Window.partitionBy(*ckeys, "team")
    later = Window.partitionBy(*ckeys, "team", "half").orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    bounds = []
    for f in range(len(STANDING_FIELDS)):
        p, q = F.col("p")[f], F.col("q")[f]
        known = F.min(p.isNotNull() & q.isNotNull()).over(whole)

        def rest(c: Column) -> Column:
            left = F.sum(c).over(later)
            beyond = F.when(F.col("half") == 0, F.sum(F.when(F.col("half") == 1, c)).over(whole)).otherwise(F.sum(F.when(F.col("half") == 0, c)).over(whole))
            return F.coalesce(left, F.lit(0)) + F.coalesce(beyond, F.lit(0))

        bounds.append(F.when(known, F.struct(rest(F.least(p, q)).alias("lo"), rest(F.greatest(p, q)).alias("hi"))))
    reach = sides.select(*ckeys, "half", "i", "role", "team", F.array(*bounds).alias("reach"))
    reach = reach.join(asked.withColumn("_shared", shared), [*ckeys, "team"])
    off = lambda v: F.when((F.col("half") == 1) & F.col("_shared"), v).otherwise(0)
    shifted = F.zip_with("reach", "need", lambda b, v: F.struct((b["lo"] - off(v)).alias("lo"), (b["hi"] - off(v)).alias("hi")))
    per = reach.select(*ckeys, "half", "i", "role", shifted.alias("reach")).groupBy(*ckeys, "half", "i").agg(
        *[F.first(F.when(F.col("role") == r, F.col("reach")), True).alias(f"{r}_reach") for r in ("home", "away")]
    )
    return halved.join(per, [*ckeys, "half", "i"], "left")


def _out_of_reach(x: Column) -> Column:
    """Whether a team of the game just decided needs what the undecided cannot give it."""
    reach = F.when(x["team"] == F.col("home_team"), F.col("home_reach")).when(x["team"] == F.col("away_team"), F.col("away_reach"))
    return F.coalesce(F.exists(F.zip_with(x["need"], reach, lambda v, b: F.coalesce((v < b["lo"]) | (v > b["hi"]), F.lit(False))), lambda out: out), F.lit(False))


def repair(suspects: DataFrame, base: DataFrame, stated: DataFrame, scope: list[str]) -> DataFrame:
    """Choose a reading of every suspect game so that its teams' totals equal the standings.

    suspects: (scope, game_id, kind pair/single, home_team, away_team, a_/b_ home, away, end); a pair is
    read as copy A or B, a single is kept (A) or dropped (B). base: totals of all settled games.
    Output per suspect: outcome repaired / ambiguous / indeterminate, the choice when it is unique, and the
    number of solutions of its component.

    The search meets in the middle. Each component's suspects are cut into two halves, whose readings are enumerated one
    suspect per round, all halves at once: the first half counts down what its teams need, the second what it takes from
    teams of both. Equal states merge (their counts add up); a team of one half only must need nothing once its last suspect is
    decided. The halves then meet in an equi-join on what the shared teams still need. So a component of n suspects has at most
    2^(n/2) states a side. A state goes as soon as a team needs less or more than its undecided suspects, of both halves, can give. A
    field that is not stated (null), or a team that is not listed, asks for nothing.
    """
    suspects = cut_lineage(suspects)
    labels = components(suspects, scope)
    comp = suspects.join(labels.withColumnRenamed("team", "home_team"), [*scope, "home_team"])
    ckeys = [*scope, "label"]
    order = F.row_number().over(Window.partitionBy(*ckeys).orderBy("game_id"))
    ah, aa = _effect(F.col("a_home"), F.col("a_away"), F.col("a_end"))
    bh, ba = _effect(F.col("b_home"), F.col("b_away"), F.col("b_end"))
    zero = F.array(*[F.lit(0)] * 5)
    single = F.col("kind") == "single"
    option_a = F.struct(F.lit("A").alias("pick"), ah.alias("h"), aa.alias("a"))
    option_b = F.struct(
        F.lit("B").alias("pick"), F.when(single, zero).otherwise(bh).alias("h"), F.when(single, zero).otherwise(ba).alias("a")
    )
    numbered = cut_lineage(
        comp.select(*ckeys, "game_id", "home_team", "away_team", order.alias("i"), F.array(option_a, option_b).alias("options"))
    )
    halved = numbered.withColumn("k", F.max("i").over(Window.partitionBy(*ckeys))).withColumn("half", (2 * F.col("i") > F.col("k") + 1).cast("int"))
    halved = halved.withColumn("i", F.col("i") - F.when(F.col("half") == 1, F.floor((F.col("k") + 1) / 2)).otherwise(0))
    # What each team needs, and the round of its half after which it must need nothing; a team of both halves is open to the end.
    hkeys = [*ckeys, "half"]
    touched = halved.select(*hkeys, "i", F.explode(F.array("home_team", "away_team")).alias("team"))
    last = touched.groupBy(*ckeys, "team").agg(F.max(F.when(F.col("half") == 0, F.col("i"))).alias("l0"), F.max(F.when(F.col("half") == 1, F.col("i"))).alias("l1"))
    need = [(F.col(f"s.{f}") - F.coalesce(F.col(f"b.{f}"), F.lit(0))).cast("int") for f in STANDING_FIELDS]
    needs = last.alias("l")
    for name, df in (("s", stated), ("b", base)):
        cond = F.lit(True)
        for c in [*scope, "team"]:
            cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"{name}.{c}"))
        needs = needs.join(df.select(*scope, "team", *STANDING_FIELDS).alias(name), cond, "left")
    shared = F.col("l0").isNotNull() & F.col("l1").isNotNull()
    here = [F.col("l0").isNotNull(), F.col("l1").isNotNull()]

    def opening(half: int) -> Column:
        """A team's entry in the first state of a half; what is shared counts from nothing in the second."""
        start = F.transform("need", lambda v: v - v) if half else F.col("need")
        value = F.when(shared, start).otherwise(F.col("need"))
        return F.when(here[half], F.struct("team", F.when(~shared, F.col(f"l{half}")).alias("last"), value.alias("need")))

    asked = cut_lineage(needs.select(*[F.col(f"l.{c}") for c in [*ckeys, "team", "l0", "l1"]], F.array(*need).alias("need")))
    halved = cut_lineage(_with_reach(halved, asked, shared, ckeys))
    opened = asked.groupBy(*ckeys).agg(*[F.array_sort(F.collect_list(opening(h))).alias(f"s{h}") for h in (0, 1)])
    start = opened.select(*ckeys, F.posexplode(F.array("s0", "s1")).alias("half", "state"))
    states = cut_lineage(start.withColumns({"ways": F.lit(1).cast("bigint"), "picks": F.lit("")}))
    rounds = halved.agg(F.max("i").alias("n")).first()["n"] or 0
    for i in range(1, rounds + 1):
        game = halved.filter(F.col("i") == i).select(*hkeys, "home_team", "away_team", "options", "home_reach", "away_reach")
        j = states.join(game, hkeys, "left").select(
            *hkeys, "state", "ways", "picks", "home_team", "away_team", "home_reach", "away_reach",
            F.explode_outer("options").alias("o"),
        )

        def less(x: Column) -> Column:
            moved = (
                F.when(x["team"] == F.col("home_team"), F.zip_with(x["need"], F.col("o.h"), lambda p, q: p - q))
                .when(x["team"] == F.col("away_team"), F.zip_with(x["need"], F.col("o.a"), lambda p, q: p - q))
                .otherwise(x["need"])
            )
            return F.struct(x["team"].alias("team"), x["last"].alias("last"), moved.alias("need"))

        moved = j.select(
            *hkeys,
            F.transform("state", less).alias("state"),
            "home_team", "away_team", "home_reach", "away_reach",
            "ways",
            F.concat("picks", F.coalesce(F.col("o.pick"), F.lit(""))).alias("picks"),
        )
        done = lambda x: F.coalesce(x["last"] <= i, F.lit(False)) & F.exists(x["need"], lambda v: F.coalesce(v != 0, F.lit(False)))
        merged = moved.filter(~F.exists("state", done) & ~F.exists("state", _out_of_reach)).groupBy(*hkeys, "state").agg(F.sum("ways").alias("ways"), F.min("picks").alias("picks"))
        states = cut_lineage(merged) if i % 4 == 0 else merged
    # First half: what the shared teams still need. Second half: what it gives them.
    common = F.filter("state", lambda x: x["last"].isNull())
    sign = F.when(F.col("half") == 0, 1).otherwise(-1)
    left = F.transform(common, lambda x: F.struct(x["team"].alias("team"), F.transform(x["need"], lambda v: F.coalesce(v, F.lit(0)) * sign).alias("need")))
    ends = cut_lineage(states.select(*hkeys, left.alias("open"), "ways", "picks"))
    first, second = (ends.filter(F.col("half") == h).select(*ckeys, "open", F.col("ways").alias(f"w{h}"), F.col("picks").alias(f"p{h}")) for h in (0, 1))
    met = first.join(second, [*ckeys, "open"])
    solved = met.groupBy(*ckeys).agg(F.sum(F.col("w0") * F.col("w1")).alias("solutions"), F.min(F.concat("p0", "p1")).alias("picks"))
    out = numbered.join(solved, ckeys, "left")
    n = F.coalesce("solutions", F.lit(0))
    outcome = F.when(n == 1, "repaired").when(n > 1, "ambiguous").otherwise("indeterminate")
    return out.select(
        *ckeys, "game_id", outcome.alias("outcome"), n.alias("solutions"),
        F.when(n == 1, F.substring(F.col("picks"), F.col("i"), F.lit(1))).alias("pick"),
    )


# ---- neutral sites ------------------------------------------------------------------------------


def neutral_signals(home_rows: DataFrame, cities: list[str]) -> DataFrame:
    """Signals that a home row was not played at home, and the verdict.

    home_rows: season, team, game_id, venue, marker_neutral, has_note. The usual venue is the modal one;
    a venue that is another team's usual one is borrowed. A differing venue without a note is a probable
    rename and does not make the game neutral.
    """
    usual = modal_by_group(home_rows, ["season", "team"], "venue").select("season", "team", F.col("modal_venue").alias("usual"))
    owners = usual.groupBy("season", F.col("usual").alias("venue")).agg(F.min("team").alias("owner"))
    j = home_rows.join(usual, ["season", "team"], "left").join(owners, ["season", "venue"], "left")
    abroad = F.col("venue").rlike("|".join(cities))
    differs = F.col("venue") != F.col("usual")
    borrowed = differs & F.coalesce(F.col("owner") != F.col("team"), F.lit(False))
    signals = F.array_compact(
        F.array(
            F.when(F.col("marker_neutral"), F.lit("marker")),
            F.when(abroad, F.lit("international-city")),
            F.when(borrowed, F.lit("borrowed-stadium")),
            F.when(differs & ~borrowed & F.col("has_note"), F.lit("relocated-with-note")),
            F.when(differs & ~borrowed & ~F.col("has_note"), F.lit("differs-without-note")),
        )
    )
    neutral = F.exists("signals", lambda s: s != "differs-without-note")
    return j.withColumn("signals", signals).withColumn("is_neutral", neutral).drop("owner")
