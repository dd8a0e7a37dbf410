"""Table comparison, fingerprints, refresh outcomes and the fixture store."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pregame.functions.scalar import same_text_number


def canonical(df: DataFrame, cols: list[str]) -> list[Column]:
    """One spelling per cell: numbers by value, other text trimmed, dates as text."""
    kinds = dict(df.dtypes)
    out = []
    for c in cols:
        if kinds[c] in ("string",):
            out.append(same_text_number(F.col(c)).alias(c))
        elif kinds[c] in ("date", "boolean") or kinds[c].startswith("timestamp"):
            out.append(F.col(c).cast("string").alias(c))
        else:
            out.append(F.col(c).cast("double").cast("string").alias(c))
    return out


def table_diff(fresh: DataFrame, served: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """Keys added, removed or changed, with the changed columns. ``carry`` columns come along for reports.

    Keys are canonicalised too, so 7 and 7.0 pair. One full outer join on the keys.
    """
    shared = [c for c in fresh.columns if c in served.columns and c not in keys]
    carry = carry or []

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            *canonical(df, keys),
            F.struct(*canonical(df, shared)).alias(f"_{tag}"),
            *[F.col(c).alias(f"_{tag}_{c}") for c in carry],
        )

    j = side(fresh, "f").join(side(served, "s"), keys, "full")
    changed = F.array_compact(
        F.array(*[F.when(~F.col(f"_f.{c}").eqNullSafe(F.col(f"_s.{c}")), F.lit(c)) for c in shared])
    )
    kind = (
        F.when(F.col("_s").isNull(), "added").when(F.col("_f").isNull(), "removed").when(F.size("cols") > 0, "changed")
    )
    both = F.col("_f").isNotNull() & F.col("_s").isNotNull()
    out = j.withColumn("cols", F.when(both, changed).otherwise(F.array().cast("array<string>"))).withColumn("change", kind)
    return out.filter("change IS NOT NULL").select(
        *keys, *[F.coalesce(f"_f_{c}", f"_s_{c}").alias(c) for c in carry], "change", F.col("cols").alias("changed_columns")
    )


def column_changes(diff: DataFrame) -> DataFrame:
    return diff.select(F.explode("changed_columns").alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("rows"))


def one_sided_columns(fresh: DataFrame, served: DataFrame) -> dict[str, list[str]]:
    return {
        "only_fresh": [c for c in fresh.columns if c not in served.columns],
        "only_served": [c for c in served.columns if c not in fresh.columns],
    }


def diff_by_season(diff: DataFrame, key: str, season: str = "season", k: int = 8) -> DataFrame:
    """Counts per season and kind, with up to ``k`` example keys."""
    from pregame.operators.sets import examples

    return examples(diff.select(season, "change", key), [season, "change"], key, k)


def fingerprint(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Row count and an order-insensitive hash of the canonical rows, per ``by``.

    The sum of 64-bit hashes is taken as a decimal, which neither overflows nor depends on order.
    """
    by = by or []
    cols = sorted(c for c in df.columns if c not in by)
    h = F.xxhash64(*[F.coalesce(c, F.lit("\x00")) for c in canonical_plain(df, cols)]).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("hash"))


def canonical_plain(df: DataFrame, cols: list[str]) -> list[Column]:
    kinds = dict(df.dtypes)
    out = []
    for c in cols:
        if kinds[c] == "string":
            out.append(same_text_number(F.col(c)))
        elif kinds[c] in ("date", "boolean") or kinds[c].startswith("timestamp"):
            out.append(F.col(c).cast("string"))
        else:
            out.append(F.col(c).cast("double").cast("string"))
    return out


def compare_catalogs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed fingerprints compared: only_left, only_right, differs."""
    l = a.select(*keys, F.col("hash").alias("_l"))
    r = b.select(*keys, F.col("hash").alias("_r"))
    state = (
        F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(F.col("_l") != F.col("_r"), "differs")
    )
    return l.join(r, keys, "full").withColumn("state", state).filter("state IS NOT NULL").select(*keys, "state")


def refresh_outcomes(before: DataFrame, after: DataFrame, failed: DataFrame, key: str = "league") -> DataFrame:
    """advanced / unchanged / carried / failed per league from the cutoffs before and after.

    A league that failed is carried when it had a snapshot before, else failed.
    """
    b = before.select(key, F.col("data_as_of").alias("was"))
    a = after.select(key, F.col("data_as_of").alias("now"))
    f = failed.select(key, F.lit(True).alias("_f"))
    outcome = (
        F.when(F.col("_f") & F.col("was").isNotNull(), "carried")
        .when(F.col("_f"), "failed")
        .when(~F.col("was").eqNullSafe(F.col("now")), "advanced")
        .otherwise("unchanged")
    )
    return b.join(a, key, "full").join(f, key, "left").select(key, "was", "now", outcome.alias("outcome"))


def corpus_fingerprint(df: DataFrame, cutoff: dt.date, folder: str, day: str = "game_date") -> DataFrame:
    """Counts and hash per folder of the rows up to a cutoff."""
    return fingerprint(df.filter(F.col(day) <= F.lit(cutoff)), [folder])


def upsert_fixtures(existing: DataFrame, incoming: DataFrame, known: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Action per fixture: insert, update (a field changed), unchanged, skipped (unknown team), kept (not incoming).

    ``incoming`` keys must be unique. The result carries the values to store.
    """
    teams = known.select("team").distinct()
    inc = (
        incoming.join(teams.select(F.col("team").alias("home_team"), F.lit(True).alias("_kh")), "home_team", "left")
        .join(teams.select(F.col("team").alias("away_team"), F.lit(True).alias("_ka")), "away_team", "left")
        .select(*keys, F.struct(*fields).alias("_new"), (F.col("_kh") & F.col("_ka")).alias("_known"))
    )
    old = existing.select(*keys, F.struct(*fields).alias("_old"))
    same = F.lit(True)
    for c in fields:
        same = same & F.col(f"_new.{c}").eqNullSafe(F.col(f"_old.{c}"))
    action = (
        F.when(F.col("_new").isNull(), "kept")
        .when(~F.coalesce("_known", F.lit(False)), "skipped")
        .when(F.col("_old").isNull(), "insert")
        .when(same, "unchanged")
        .otherwise("update")
    )
    out = old.join(inc, keys, "full").withColumn("action", action)
    values = F.when(F.col("action").isin("insert", "update"), F.col("_new")).otherwise(F.col("_old"))
    return out.withColumn("_v", values).select(*keys, "action", *[F.col(f"_v.{c}").alias(c) for c in fields])
