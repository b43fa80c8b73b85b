import json

import pytest

from lanewright.operators import nested
from tests.conftest import rows

PULLS = "raw_id long, pulled_at timestamp_ntz, payload string, match_id string, extra int"


def pull(spark, *payloads):
    from datetime import datetime

    return spark.createDataFrame([(i + 1, datetime(2026, 1, 1 + i), p, "clash", 0) for i, p in enumerate(payloads)], PULLS)


def match(i, players, **more):
    return {"match_id": i, "players": players, **more}


def player(slot, items, **more):
    return {"player_slot": slot, "items": items, **more}


def test_shapes(spark):
    one = match(1, [player(1, [{"item_id": 10}, None, {"item_id": "20"}])])
    payloads = [
        json.dumps(one),
        json.dumps({"status": "ok", "data": [match("2", {"7": {"items": {"item_id": 30}}})]}),
        json.dumps(json.dumps(match(3, [player("4", json.dumps([{"item_id": 40}]))]))),
        json.dumps({"match_info": match(4, None), "cached": True}),
        json.dumps([match(5, [player(1, [])]), match(6, [player(2, [{"item_id": None}, {"item_id": 60}])])]),
        '{"match_id": 9, "players": [',
        "",
        None,
        "[]",
        '"text"',
        "17",
    ]
    got = rows(nested.item_entries(pull(spark, *payloads)))
    assert got == [(1, 1, 0, 10), (1, 1, 2, 20), (2, 7, 0, 30), (3, 4, 0, 40), (6, 2, 1, 60)]


def test_latest_valid_pull(spark):
    old, new = match(1, [player(1, [{"item_id": 1}])]), match(1, [player(1, [{"item_id": 2}])])
    assert rows(nested.item_entries(pull(spark, json.dumps(old), json.dumps(new), json.dumps(new)[:-3]))) == [(1, 1, 0, 2)]


def test_tie_goes_to_the_larger_document(spark):
    from datetime import datetime

    made = [json.dumps(match(1, [player(1, [{"item_id": i}])])) for i in (1, 2)]
    df = spark.createDataFrame([(i, datetime(2026, 1, 1), p, "", 0) for i, p in enumerate(made)], PULLS)
    assert rows(nested.item_entries(df)) == [(1, 1, 0, 2)]


def test_empty_table(spark):
    assert rows(nested.item_entries(pull(spark).limit(0))) == []


def test_intervals_nest():
    walker = nested.Walker(nested.EVERY)
    walker.read(1, json.dumps([match(1, [player(1, [{"item_id": 1, "imbue": {"target": {"ability_id": 5}}}], stats=[{"net_worth": 3}])]), match(2, [])]))
    by = {t.name: r for t, r in zip(nested.EVERY, walker.rows)}
    (_, m_pre, m_post, *_), (_, n_pre, *_) = by["match"]
    (_, p_pre, p_post, *_) = by["player"][0]
    (_, i_pre, i_post, *_) = by["item"][0]
    assert m_pre < p_pre < i_pre < i_post < p_post < m_post < n_pre
    assert by["item"][0][-1] == 5 and len(by["stat"]) == 1


def test_deep_nesting_is_no_crash(spark):
    assert rows(nested.item_entries(pull(spark, "[" * 100_000 + "]" * 100_000))) == []


def test_flat_tables_keep_links(spark):
    m = match(1, [player(1, [{"item_id": 5}], hero_id="3"), player(2, [{"item_id": 6}])], objectives=[{"team_objective": "Tier2Lane1", "destroyed_time_s": 300, "team": "Team0"}])
    flat = nested.flat_tables(pull(spark, json.dumps(m)))
    items = flat["item"].join(flat["player"].select("doc", flat["player"]["pre"].alias("player_pre"), "hero_id"), ["doc", "player_pre"])
    assert rows(items, "match_id", "player_slot", "item_id", "hero_id") == [(1, 1, 5, 3), (1, 2, 6, None)]
    assert rows(flat["objective"], "match_id", "loser") == [(1, "Team0")]


@pytest.mark.parametrize("value,want", [(3, 3), ("4", 4), ("x", None), (2.0, 2), (2.5, None), (True, None), (1 << 70, None), (float("nan"), None)])
def test_numbers(value, want):
    assert nested._long(value) == want


@pytest.mark.parametrize("times", [3, 5])
def test_payloads_encoded_several_times(spark, times):
    payload = match(1, [player(1, [{"item_id": 10}])])
    for _ in range(times):
        payload = json.dumps(payload)
    assert rows(nested.item_entries(pull(spark, payload))) == [(1, 1, 0, 10)]


def test_json_strings_in_wrappers(spark):
    one = lambda i: match(i, [player(1, [{"item_id": i}])])
    payloads = [json.dumps({"note": "[no JSON", "data": json.dumps([one(1), one(2)])}), json.dumps([json.dumps(one(3)), {"body": json.dumps(json.dumps({"match": one(4)}))}])]
    assert rows(nested.item_entries(pull(spark, *payloads))) == [(i, 1, 0, i) for i in (1, 2, 3, 4)]


def test_deep_nesting_keeps_the_rest_of_the_document(spark):
    n = 100_000
    deep = "[" * n + "1" + "]" * n
    objects = '{"a": ' * n + "null" + " }" * n
    payloads = [
        '{"match_id": 1, "extra": %s, "players": [{"player_slot": 1, "debug": %s, "items": [{"item_id": 10}]}]}' % (deep, objects),
        '{"log": %s, "data": {"match_id": 2, "players": [{"player_slot": 2, "items": [{"item_id": 20}]}]}}' % deep,
        "[" * n + '{"match_id": 3, "players": [{"player_slot": 3, "items": [{"item_id": 30}]}]}' + "]" * n,
        '{"match_id": 4, "extra": %s, "players": [{"player_slot": 4, "items": [{"item_id": 40}]}]' % deep,
    ]
    assert rows(nested.item_entries(pull(spark, *payloads))) == [(1, 1, 0, 10), (2, 2, 0, 20), (3, 3, 0, 30)]


@pytest.mark.parametrize("text", ['[1, {"a": [], "b": {}, "c": "x\\n\\u00e9", "a": -1.5e3}, true, null] ', "[]", " 3", '"a"', "[1,]", '{"a"}', '{"a": 1,}', "[1 2]", "[1] 2", "{1: 2}", "", "[", '{"a": ', "nul", "[1}"])
def test_the_stack_parser_equals_json(text):
    try:
        want = json.loads(text)
    except ValueError:
        with pytest.raises(ValueError):
            nested._deep(text)
    else:
        assert nested._deep(text) == want
