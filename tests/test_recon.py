from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from conftest import SMALL

from pregame.operators import recon
from pregame.plans.recon_queries import repair_inputs
from pregame.sources import views


def greedy(rows):
    """Reference pairing: date order, each row takes the first unused row of the other copy within a day."""
    groups = {}
    for r in rows:
        groups.setdefault((r["league"], min(r["home_team"], r["away_team"]), max(r["home_team"], r["away_team"])), []).append(r)
    pairs, singles = set(), set()
    for group in groups.values():
        group.sort(key=lambda r: (r["copy_date"], r["copy"], r["game_id"]))
        used = [False] * len(group)
        for i, r in enumerate(group):
            if used[i]:
                continue
            used[i] = True
            for j in range(i + 1, len(group)):
                other = group[j]
                if not used[j] and other["copy"] != r["copy"] and abs((other["copy_date"] - r["copy_date"]).days) <= 1:
                    used[j] = True
                    pairs.add(frozenset([(r["copy"], r["game_id"]), (other["copy"], other["game_id"])]))
                    break
            else:
                singles.add((r["copy"], r["game_id"]))
    return pairs, singles


def spark_pairing(df):
    out = recon.pair_copies(df, ["league"]).collect()
    by_slot, singles = {}, set()
    for r in out:
        if r["slot"] is None:
            singles.add((r["copy"], r["game_id"]))
        else:
            by_slot.setdefault((r["league"], r["pair"], r["slot"]), []).append((r["copy"], r["game_id"]))
    assert all(len(v) == 2 for v in by_slot.values())
    return {frozenset(v) for v in by_slot.values()}, singles


def test_pairing_on_the_whole_table(spark):
    df = views.copies(spark, SMALL)
    assert spark_pairing(df) == greedy([r.asDict() for r in df.collect()])


@pytest.mark.parametrize("seed", range(5))
def test_pairing_on_crowded_days(spark, seed):
    rnd = random.Random(seed)
    data = []
    for i in range(120):
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randrange(9))
        teams = rnd.choice([(1, 2), (2, 1), (3, 4)])
        data.append(("L", i, teams[0], teams[1], rnd.choice("AB"), day))
    df = spark.createDataFrame(data, "league string, game_id bigint, home_team int, away_team int, copy string, copy_date date")
    assert spark_pairing(df) == greedy([r.asDict() for r in df.collect()])


def _vec(own, other, end):
    win, lost = int(own > other), int(own < other)
    return (win, lost * int(end == "REG"), lost * int(end != "REG"), int(own), int(other))


def brute_force(suspects, base, stated):
    """Try every assignment of every component of one scope."""
    parent = {}

    def find(t):
        parent.setdefault(t, t)
        while parent[t] != t:
            t = parent[t]
        return t

    for s in suspects:
        parent[find(s["home_team"])] = find(s["away_team"])
    comps = {}
    for s in sorted(suspects, key=lambda s: s["game_id"]):
        comps.setdefault(find(s["home_team"]), []).append(s)
    out = {}
    for comp in comps.values():
        teams = {t for s in comp for t in (s["home_team"], s["away_team"])}
        solutions = []
        for picks in itertools.product("AB", repeat=len(comp)):
            total = {t: list(base.get(t, (0,) * 5)) for t in teams}
            for s, pick in zip(comp, picks):
                if pick == "B" and s["kind"] == "single":
                    continue
                h, a, e = (s["a_home"], s["a_away"], s["a_end"]) if pick == "A" else (s["b_home"], s["b_away"], s["b_end"])
                for t, v in ((s["home_team"], _vec(h, a, e)), (s["away_team"], _vec(a, h, e))):
                    total[t] = [x + y for x, y in zip(total[t], v)]
            if all(tuple(total[t]) == stated.get(t, (0,) * 5) for t in teams):
                solutions.append(picks)
        for i, s in enumerate(comp):
            n = len(solutions)
            out[s["game_id"]] = (
                "repaired" if n == 1 else "ambiguous" if n > 1 else "indeterminate", n, solutions[0][i] if n == 1 else None
            )
    return out


def test_repair_against_brute_force(spark):
    suspects, base, stated, scope = repair_inputs(spark, SMALL)
    got = {r["game_id"]: (r["outcome"], r["solutions"], r["pick"]) for r in recon.repair(suspects, base, stated, scope).collect()}
    fields = ["win", "loss", "otl", "gf", "ga"]
    tab = lambda df: {(r["league"], r["round"], r["team"]): tuple(r[f] for f in fields) for r in df.collect()}
    b, s = tab(base), tab(stated)
    want = {}
    groups = {}
    for r in suspects.collect():
        groups.setdefault((r["league"], r["round"]), []).append(r.asDict())
    for key, group in groups.items():
        pick = lambda t, key=key: {k[2]: v for k, v in t.items() if k[:2] == key}
        want.update(brute_force(group, pick(b), pick(s)))
    assert got == want and len(got) > 20


def test_repair_kinds_and_large_component(spark):
    """A chain of 16 games is solved, an over-stated team is indeterminate, a symmetric pair ambiguous."""
    sus = [("L", 1, i, i, i + 1, "pair", 3.0, 1.0, "REG", 3.0, 2.0, "REG") for i in range(16)]
    sus += [("M", 1, 100, 1, 2, "pair", 3.0, 1.0, "REG", 3.0, 2.0, "REG"), ("M", 1, 101, 1, 2, "pair", 3.0, 1.0, "REG", 3.0, 2.0, "REG")]
    sus += [("N", 1, 200, 1, 2, "single", 3.0, 1.0, "REG", 3.0, 1.0, "REG")]
    schema = (
        "league string, round int, game_id bigint, home_team int, away_team int, kind string, a_home double, a_away double, a_end string, "
        "b_home double, b_away double, b_end string"
    )
    suspects = spark.createDataFrame(sus, schema)
    # Truth of L: even games as copy A, odd games as copy B.
    truth = {}
    for lg, _, g, h, a, _k, hp, ap, e, bh, bp, be in sus:
        if lg != "L":
            continue
        use = (hp, ap, e) if g % 2 == 0 else (bh, bp, be)
        for t, v in ((h, _vec(use[0], use[1], use[2])), (a, _vec(use[1], use[0], use[2]))):
            truth[t] = tuple(x + y for x, y in zip(truth.get(t, (0,) * 5), v))
    stated_rows = [("L", 1, t, *v) for t, v in truth.items()]
    stated_rows += [("M", 1, 1, 2, 0, 0, 6, 3), ("M", 1, 2, 0, 2, 0, 3, 6)]  # one A and one B, either way round
    stated_rows += [("N", 1, 1, 5, 0, 0, 9, 9), ("N", 1, 2, 0, 1, 0, 1, 3)]
    st = spark.createDataFrame(stated_rows, "league string, round int, team int, win int, loss int, otl int, gf int, ga int")
    out = {r["game_id"]: r for r in recon.repair(suspects, st.limit(0), st, ["league", "round"]).collect()}
    assert [out[i]["pick"] for i in range(16)] == ["A", "B"] * 8
    assert out[100]["outcome"] == "ambiguous" and out[100]["solutions"] == 2
    assert out[200]["outcome"] == "indeterminate"


def test_components(spark):
    edges = spark.createDataFrame([("L", 5, 4), ("L", 4, 3), ("L", 3, 9), ("L", 7, 8), ("M", 1, 2)], "league string, home_team int, away_team int")
    got = {(r["league"], r["team"]): r["label"] for r in recon.components(edges, ["league"]).collect()}
    assert got == {("L", 5): 3, ("L", 4): 3, ("L", 3): 3, ("L", 9): 3, ("L", 7): 7, ("L", 8): 7, ("M", 1): 1, ("M", 2): 1}


def test_delta_shapes(spark):
    data = [(1, 0, 0, 0, 1, 0), (2, 0, -1, 1, 0, 0), (3, -1, 0, 0, -3, -2), (4, 1, 0, 0, 2, 0)]
    df = spark.createDataFrame(data, "team int, d_win int, d_loss int, d_otl int, d_gf int, d_ga int")
    got = {r["team"]: r["shape"] for r in recon.delta_shape(df).collect()}
    assert got == {1: "score_only", 2: "result_label", 3: "games_missing", 4: "mixed"}


def test_quarantine_report(spark):
    prev = spark.createDataFrame([(1,), (2,)], "game_id int")
    now = spark.createDataFrame([(2,)], "game_id int")
    assert [r["game_id"] for r in recon.left_quarantine(prev, now, ["game_id"]).collect()] == [1]


def test_repair_of_forty_suspects_among_three_teams(spark):
    """A dense component: no team is settled early, so one walk over all suspects would hold up to 2^40 states."""
    rnd = random.Random(9)
    sus, truth = [], {}
    for i in range(40):
        h, a = rnd.sample([1, 2, 3], 2)
        # totals that identify the reading: powers of two apart, copy B gives other goals
        row = ("L", 1, i, h, a, "pair", float(3**12 + i), float(rnd.randrange(3**11)), "REG", float(3**12 + rnd.randrange(3**11)), float(rnd.randrange(3**11)), "REG")
        sus.append(row)
        use = row[6:9] if rnd.random() < 0.5 else row[9:12]
        for t, v in ((h, _vec(use[0], use[1], use[2])), (a, _vec(use[1], use[0], use[2]))):
            truth[t] = tuple(x + y for x, y in zip(truth.get(t, (0,) * 5), v, strict=True))
        sus[-1] = (*row, "A" if use == row[6:9] else "B")
    schema = (
        "league string, round int, game_id bigint, home_team int, away_team int, kind string, a_home double, a_away double, a_end string, "
        "b_home double, b_away double, b_end string, truth string"
    )
    df = spark.createDataFrame(sus, schema)
    st = spark.createDataFrame([("L", 1, t, *v) for t, v in truth.items()], "league string, round int, team int, win int, loss int, otl int, gf int, ga int")
    out = {r["game_id"]: r for r in recon.repair(df.drop("truth"), st.limit(0), st, ["league", "round"]).collect()}
    assert all(r["solutions"] == 1 for r in out.values())
    assert [out[i]["pick"] for i in range(40)] == [s[-1] for s in sus]


def test_repair_drops_states_that_cannot_be_met(spark, monkeypatch):
    """Copy B always gives more goals than are stated: no state but the true one outlives its round (2^12 a half without bounds)."""
    rnd = random.Random(3)
    sus, truth = [], {}
    for i in range(24):
        h, a = rnd.sample([1, 2, 3], 2)
        more = float(4**10 + rnd.randrange(4**10))
        sus.append(("L", 1, i, h, a, "pair", 9e6, 5.0 + i, "REG", 9e6, 5.0 + i + more, "REG"))
        for t, v in ((h, _vec(9e6, 5.0 + i, "REG")), (a, _vec(5.0 + i, 9e6, "REG"))):
            truth[t] = tuple(x + y for x, y in zip(truth.get(t, (0,) * 5), v, strict=True))
    schema = (
        "league string, round int, game_id bigint, home_team int, away_team int, kind string, a_home double, a_away double, a_end string, "
        "b_home double, b_away double, b_end string"
    )
    st = spark.createDataFrame([("L", 1, t, *v) for t, v in truth.items()], "league string, round int, team int, win int, loss int, otl int, gf int, ga int")
    sizes, cut = [], recon.cut_lineage

    def counted(df):
        out = cut(df)
        sizes.append(out.count() if "ways" in out.columns else 0)
        return out

    monkeypatch.setattr(recon, "cut_lineage", counted)
    out = recon.repair(spark.createDataFrame(sus, schema), st.limit(0), st, ["league", "round"]).collect()
    assert {(r["outcome"], r["solutions"], r["pick"]) for r in out} == {("repaired", 1, "A")}
    assert max(sizes) == 2
