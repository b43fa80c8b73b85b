import json

import pytest
from pyspark.sql import functions as F

from lanewright.operators import evaluation
from lanewright.plans import registry
from lanewright.sources import assets, pages, sinks
from lanewright.streaming import purchases as stream
from tests.conftest import rows


def test_pages(spark, tmp_path):
    one = [{"match_id": 1, "winning_team": "Team0", "players": [{"player_slot": 1, "items": [{"item_id": 5, "game_time_s": 9}]}], "objectives": []}, {"match_id": 2}]
    (tmp_path / "a.json").write_text(json.dumps(one))
    (tmp_path / "b.json").write_text(json.dumps([{"match_id": 1, "winning_team": "Team1"}, {"match_id": 3, "players": []}]))
    matches = pages.read_pages(spark, str(tmp_path))
    assert rows(matches, "match_id", "winning_team") == [(1, "Team0"), (2, None), (3, None)]
    assert rows(pages.players(matches), "match_id", "player_slot", "has_objectives") == [(1, 1, True)]
    assert rows(pages.entries(matches), "item_id", "pos") == [(5, 0)]


def test_fetching(tmp_path):
    calls, waits = [], []
    pace = pages.Pace(now=lambda: 0.0, sleep=waits.append)

    def fetch(path, params):
        calls.append(path)
        if len(calls) == 1:
            raise pages.Refused(3)
        return {"n": params["n"]}

    assert pages.fetched(fetch, "/v1/x", {"n": 1}, tmp_path, pace) == {"n": 1}
    assert pages.fetched(fetch, "/v1/x", {"n": 1}, tmp_path, pace) == {"n": 1} and len(calls) == 2
    assert 4 in waits and not list(tmp_path.glob("*.tmp"))
    pulled = list(pages.pulled(lambda below: [{"match_id": i} for i in range((below or 10), max((below or 10) - 4, 0), -1)], 100, 4))
    assert [r["match_id"] for p in pulled for r in p] == list(range(10, 0, -1))


def test_assets(spark, tmp_path):
    raw = [
        {"id": 1, "type": "upgrade", "class_name": "u1", "name": "A", "item_tier": 1, "shopable": True},
        {"id": 2, "type": "upgrade", "class_name": "u2", "name": "B", "item_tier": 2, "cost": 9, "shopable": True, "disabled": True, "component_items": ["u3", "u1"]},
        {"id": 3, "type": "upgrade", "class_name": "u3", "name": "C", "shopable": False},
        {"id": 8, "type": "ability", "class_name": "a1", "name": "X", "hero": 7},
    ]
    (tmp_path / "items.json").write_text(json.dumps(raw))
    (tmp_path / "heroes.json").write_text(json.dumps([{"id": 7, "name": "H", "items": {"signature2": "a1"}}, {"id": 9, "name": "Z", "disabled": True}]))
    read = assets.read_items(spark, str(tmp_path / "items.json"))
    assert rows(assets.upgrades(read), "id", "cost") == [(1, 0), (2, 9), (3, 0)]
    assert rows(assets.shop(read), "id") == [(1,)]
    assert rows(assets.components(read)) == [(2, [3, 1])]
    heroes = assets.heroes(spark, str(tmp_path / "heroes.json"))
    assert rows(assets.playable(heroes), "id") == [(7,)]
    assert rows(assets.signatures(heroes, assets.abilities(read))) == [(7, 2, 8)]


def test_sinks(spark, tmp_path):
    levels = spark.createDataFrame([(0, "7|1", 5, 2.0, 2), (5, "7", 5, 1.0, 1)], "level int, ctx string, item_id long, w double, n long")
    shares = spark.createDataFrame([(7, 0, 1.0)], "hero_id int, archetype_id int, share double")
    sinks.save_model(levels, shares, str(tmp_path / "m"), kappa=20.0, target=None)
    back, s, facts = sinks.load_model(spark, str(tmp_path / "m"))
    assert rows(back, *levels.columns) == rows(levels) and rows(s) == rows(shares) and facts == {"kappa": "20.0", "target": None}
    sinks.write_csv(shares, str(tmp_path / "c"))
    assert rows(sinks.read_csv(spark, str(tmp_path / "c"), "hero_id int, archetype_id int, share double")) == rows(shares)
    assert "&lt;b&gt;" in sinks.html_table(spark.createDataFrame([("<b>",)], "x string"), "t") and "| 7 | 0 | 1.0 |" in sinks.markdown_table(shares)


BUYS = "match_id long, player_slot int, item_id long, buy_index int, buy_time_s double, pulled_at timestamp"


def run(query, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60), "the stream did not end"
    q.stop()
    return query.sparkSession.sql(f"select * from {name}")


def test_streams(spark, tmp_path):
    from datetime import datetime

    t = lambda s: datetime(2026, 1, 1, 0, 0, s)
    data = [(1, 1, 10, 0, 5.0, t(0)), (1, 1, 10, 0, 5.0, t(1)), (1, 1, 11, 1, 9.0, t(3)), (1, 1, 12, 2, 20.0, t(40)), (None, 1, 13, 0, 1.0, t(2))]
    spark.createDataFrame(data, BUYS).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: stream.read_stream(spark, str(tmp_path / "in"), BUYS)
    assert run(stream.distinct_purchases(read()), "once").where("match_id = 1").count() == 3
    got = rows(run(stream.contexts(read()), "ctx"), "item_id", "prev_one", "prev_two")
    assert got == [(10, -1, -1), (10, 10, -1), (11, 10, 10), (12, 11, 10)]
    late = run(stream.visits(read(), "pulled_at", late="1 second"), "visits")
    assert [r["n"] for r in late.where("match_id = 1").collect()] in ([], [3])


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 60


def test_prevalence_without_group(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 1, 5), (2, 1, 6)], "match_id long, player_slot int, item_id long")
    assert rows(evaluation.prevalence(df), "item_id", "share") == [(5, 0.5), (6, 0.5)]


def test_stored_tables_are_deleted(spark):
    from pathlib import Path

    from lanewright import runtime

    runtime.forget(spark)
    df = runtime.stored(spark.range(5), "gone")
    path = Path(df.inputFiles()[0].removeprefix("file://").removeprefix("file:")).parent
    assert df.count() == 5 and path.exists()
    assert runtime.forget(spark) == 1 and not path.exists() and runtime.forget(spark) == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from lanewright import runtime

    none = SimpleNamespace(get=lambda *_: None)
    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(getConf=lambda: none, master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(RuntimeError, match="checkpoint"):
        runtime.shared_folder(SimpleNamespace(sparkContext=context, conf=none))
