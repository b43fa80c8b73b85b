"""Queries over match pulls keep small plans: the driver holds every node of a plan, and at 1 GB it had no room for hundreds of exchanges."""

import json
from datetime import datetime
from pathlib import Path

import pytest

from lanewright.plans import registry

SHOP = "id long, class_name string, name string, slot_type string, tier int, cost int, imbue string"


def pulls(spark, folder):
    """Two pulls of one match, of which the later counts, and another match; player 2 imbues nothing."""
    item = lambda i, t, **more: {"item_id": i, "game_time_s": t, **more}
    point = lambda i, t: {"item_id": i, "game_time_s": t, "upgrade_info": 1 << 16}
    match = lambda i, target: {"match_id": i, "winning_team": "Team0", "match_outcome": "TeamWin", "players": [
        {"player_slot": 1, "hero_id": 5, "team": "Team0", "items": [point(8, 60), point(7, 30), item(100, 90, imbued_ability_id=target)]},
        {"player_slot": 2, "hero_id": 5, "team": "Team1", "items": [point(7, 20), item(100, 80)]},
    ]}
    rows = [(1, datetime(2026, 1, 1), json.dumps(match(1, 8))), (2, datetime(2026, 1, 2), json.dumps(match(1, 7))), (3, datetime(2026, 1, 1), json.dumps(match(2, 8)))]
    spark.createDataFrame(rows, "raw_id long, pulled_at timestamp_ntz, payload string").write.parquet(f"{folder}/raw_matches.parquet")
    spark.createDataFrame([(100, "a", "A", "spirit", 1, 500, "active")], SHOP).write.parquet(f"{folder}/items.parquet")


CASES = {
    # player 1 aims at slot 1 (ability 7) in one match and at slot 2 in the other; player 2 gets the hero's mean
    "conditional_imbues": (8, {(1, 1, 1.0, *[0.0] * 7), (2, 1, 0.0, 1.0, *[0.0] * 6), (1, 2, 0.5, 0.5, *[0.0] * 6), (2, 2, 0.5, 0.5, *[0.0] * 6)}),
    "imbue_features": (5, {(1, 1, 1.0, *[0.0] * 7, 0.25, 1), (2, 1, 0.0, 1.0, *[0.0] * 6, 0.25, 1), (1, 2, *[0.0] * 9, 0), (2, 2, *[0.0] * 9, 0)}),
    "level_at_imbue": (10, {(1, "active", 1, 1), (2, "active", 1, 1)}),
    "slot_order": (8, {(1, 1, 1, 2, 0, 0), (2, 1, 1, 2, 0, 0), (1, 2, 1, 0, 0, 0), (2, 2, 1, 0, 0, 0)}),
    "gated_heroes": (14, {(5,)}),
    "imbue_rate": (6, {(5, 0.5)}),
    "archetype_focus": (15, set()),
    "entry_reconciliation": (3, {(4, 6, 10, True)}),
    "item_direction": (9, {(5, 100, 2, 2, 0.5, 1, 0.5, 1.0)}),
}


@pytest.mark.parametrize("name", CASES)
def test_plans_of_pulls_are_small(spark, tmp_path, name):
    pulls(spark, str(tmp_path))
    most, want = CASES[name]
    df = registry.queries()[name](spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= most
    assert {tuple(r) for r in df.collect()} == want


def test_a_stream_of_small_files_takes_few_batches(spark, tmp_path):
    from lanewright import runtime

    bought = [(i, datetime(2026, 1, 1, i % 3)) for i in range(6)]
    spark.createDataFrame(bought, "hero_id int, pulled_at timestamp_ntz").repartition(6, "hero_id").write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "purchases.parquet"))
    assert len(list((tmp_path / "purchases.parquet").glob("*.parquet"))) == 6
    told = registry.queries()["stream_hourly"](spark, str(tmp_path))
    assert {tuple(r)[1:] for r in told.collect()} == {(i, 1) for i in range(6)}
    offsets = f"{runtime._kept[spark.sparkContext.applicationId][-1]}/state/offsets".removeprefix("file://")
    assert len([p for p in Path(offsets).iterdir() if p.name.isdigit()]) == 1


def test_evidence_adds_up_its_parts_once(spark, tmp_path):
    bought = [(m, 1, m, 5, "Team0", True, 80, 7, 10.0, 0, 100.0) for m in (1, 2)]
    schema = "match_id long, player_slot int, account_id long, hero_id int, team string, won boolean, average_badge int, item_id long, buy_time_s double, buy_index int, nw_at_buy double"
    spark.createDataFrame(bought, schema).write.parquet(str(tmp_path / "purchases.parquet"))
    df = registry.queries()["evidence"](spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 12
    # after one purchase only the hero's own context was seen: 2 purchases, share 2 / (2 + 20)
    assert {tuple(r) for r in df.collect()} == {(f"{m}/1", 7, 0.090909, 5, 2) for m in (1, 2)}
