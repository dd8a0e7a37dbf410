"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

$BENCH_QUERIES may hold a comma-separated list of names, or ``all``. Each query is planned and run once
with its result written to Spark's no-op sink, after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

HEADLINE = [
    "game_features", "trailing_mean", "rolling_season", "rolling_career", "player_trailing_minutes", "rest_days", "games_last_7",
    "travel", "road_trip", "on_off", "absence_weights", "running_record_reanchored", "checked_join", "opponent_values",
    "wide_game_rows", "entity_match", "suffix_match", "aligned_frames", "shot_quality", "standings_totals", "collapsed_lines",
    "schedule_shape", "break_clusters", "elo_nba", "elo_nfl", "elo_as_of_nba", "elo_parameter_search", "fold_ratings",
    "predictable_fixtures", "fixture_status", "fixture_features", "table_diff", "table_fingerprints", "copy_quarantine",
    "standings_repair", "mirror_violations", "advanced_stat_violations", "truncation_test", "roc_auc", "reliability_bins",
    "paired_bootstrap", "promotion_gate", "empirical_margin_probability", "logistic_winner_model", "stream_deduplication",
]


def main() -> None:
    from pregame.plans.catalog import load
    from pregame.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    registry = load()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(registry) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    registry["value_counts"].build(spark, sf_dir).collect()
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        start = time.perf_counter()
        try:
            registry[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:200]
        print(f"{name} {times.get(name, 'failed')}", file=sys.stderr, flush=True)
    line = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    if failed:
        line["failed"] = failed
    print(json.dumps(line))


if __name__ == "__main__":
    main()
