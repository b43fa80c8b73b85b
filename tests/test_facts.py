import json

import pytest
from pyspark.sql import functions as F

from lanewright.operators import facts, nested
from tests.conftest import rows

SHOP = [(100,), (200,), (300,)]


def flat(spark, *matches):
    return nested.flat_tables(spark.createDataFrame([(i, json.dumps(m), i) for i, m in enumerate(matches)], "raw_id long, payload string, pulled_at long"))


def player(slot, team, per_second, items=(), **extra):
    return {"player_slot": slot, "team": team, "hero_id": 10 + slot, "stats": [{"time_stamp_s": t, "net_worth": per_second * t} for t in (540, 180, 360)], "items": list(items), **extra}


def match(**extra):
    bought = [{"item_id": 200, "game_time_s": 300, "sold_time_s": 900}, {"item_id": 100, "game_time_s": 90}, None, {"item_id": 7, "game_time_s": 60, "upgrade_info": 3 << 16 | 1}, {"item_id": 300}]
    return {
        "match_id": 42, "winning_team": "Team0", "match_outcome": "TeamWin", "average_badge": 60, "duration_s": 1800,
        "players": [player(1, "Team0", 10, bought, hero_build_id=0, pregame_hero_id=3), player(2, "Team0", 30), player(3, "Team1", 20, [{"item_id": 100, "game_time_s": 180, "imbue": {"target": {"ability_id": 7}}}]), player(4, "Team1", 20)],
        **extra,
    }


def test_purchase_facts(spark):
    objectives = [{"team_objective": "Tier2Lane1", "team": "Team1", "destroyed_time_s": 700}, {"team_objective": "Tier2Lane3", "team": "Team1", "destroyed_time_s": 500}, {"team_objective": "Tier2Lane3", "team": "Team0", "destroyed_time_s": 1}, {"team_objective": "Core", "team": "Team0", "destroyed_time_s": 900}]
    boss = [{"team_killed": "Team0", "team_claimed": "Team1", "destroyed_time_s": 800}, {"team_killed": "Team1", "destroyed_time_s": 650}]
    got = facts.purchase_facts(flat(spark, match(objectives=objectives, mid_boss=boss)), spark.createDataFrame(SHOP, "id long"))
    told = {(r["player_slot"], r["buy_index"]): r for r in got.collect()}
    assert {k: (r["item_id"], r["buy_time_s"], r["sold"], r["sold_time_s"]) for k, r in told.items()} == {(1, 0): (100, 90, False, 0), (1, 1): (200, 300, True, 900), (3, 0): (100, 180, False, 0)}
    a = told[1, 0]
    assert (a["won"], a["hero_build_id"], a["pregame_hero_id"], a["has_objectives"], a["phase"]) == (True, None, 3, True, 0)
    assert (a["kill_1"], a["kill_2"], a["boss_s"]) == (500, 700, None) and (told[3, 0]["kill_1"], told[3, 0]["boss_s"], told[3, 0]["won"]) == (None, 650, False)
    assert a["nw_at_buy"] == pytest.approx(900) and a["nw_vs_match_median"] == pytest.approx(0.5) and a["nw_vs_team_avg"] == pytest.approx(0.5) and a["nw_vs_enemy_avg"] == pytest.approx(0.5)
    assert a["nw_rank_in_match"] == 0 and told[3, 0]["nw_rank_in_match"] == pytest.approx(1 / 3)
    assert [r["nw_quintile"] for r in facts.with_quintiles(got).orderBy("nw_at_buy").collect()] == [0, 2, 4]


def test_facts_without_results_or_objectives(spark):
    bare = facts.purchase_facts(flat(spark, match()), spark.createDataFrame(SHOP, "id long")).collect()
    assert len(bare) == 3 and {r["has_objectives"] for r in bare} == {False} and {r["kill_1"] for r in bare} == {None}
    empty = facts.purchase_facts(flat(spark, match(objectives=[])), spark.createDataFrame(SHOP, "id long")).collect()
    assert {r["has_objectives"] for r in empty} == {True}
    assert facts.purchase_facts(flat(spark, match(winning_team="Spectator")), spark.createDataFrame(SHOP, "id long")).count() == 0
    assert facts.purchase_facts(flat(spark), spark.createDataFrame(SHOP, "id long")).count() == 0


def test_points_and_imbues(spark):
    tables, shop = flat(spark, match()), spark.createDataFrame(SHOP, "id long")
    slots = spark.createDataFrame([(11, 7, 2)], "hero_id long, ability_id long, signature_slot int")
    assert rows(facts.point_facts(tables, shop, slots), "player_slot", "ability_id", "signature_slot", "level", "game_time_s", "step") == [(1, 7, 2, 2, 60, 0)]
    imbueable = spark.createDataFrame([(100, "active")], "item_id long, imbue_group string")
    assert rows(facts.imbue_facts(tables, imbueable, slots), "player_slot", "item_id", "imbued_ability_id", "signature_slot", "imbue_group") == [(3, 100, 7, -1, "active")]
    assert rows(facts.reconciled(tables, shop)) == [(4, 1, 5, True)]


def test_curves_are_read_on_straight_lines(spark):
    df = spark.createDataFrame([(t,) for t in (-5.0, 0.0, 90.0, 180.0, 270.0, 999.0)], "t double")
    curve = facts.from_origin(F.array(F.struct(F.lit(180.0).alias("t"), F.lit(100.0).alias("w")), F.struct(F.lit(360.0).alias("t"), F.lit(300.0).alias("w"))))
    assert [r[0] for r in df.select(facts.on_curve(curve, F.col("t"))).collect()] == [0.0, 0.0, 50.0, 100.0, 200.0, 300.0]
    late = F.array(F.struct(F.lit(-10.0).alias("t"), F.lit(7.0).alias("w")))
    assert [r[0] for r in df.select(facts.on_curve(facts.from_origin(late), F.col("t"))).collect()] == [7.0] * 6
