import pytest

from lanewright import __main__ as cli
from lanewright.operators import advice
from lanewright.sources import sinks
from tests.test_advice import model

TABLES = "/root/testdata/sf0.001"


def test_commands(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "item_prevalence" in capsys.readouterr().out
    assert cli.main(["run", "nothing", TABLES]) == 2
    path = str(tmp_path / "model")
    assert cli.main(["fit", TABLES, path, "--badge", "all"]) == 0 and "all badges" in capsys.readouterr().out
    hero = str(spark.read.parquet(f"{path}/shares").first()["hero_id"])
    item = str(spark.read.parquet(f"{TABLES}/items.parquet").first()["id"])
    assert cli.main(["next", path, TABLES, "--hero", hero, "--time", "5:00", "-n", "2"]) == 0 and "place" in capsys.readouterr().out
    assert cli.main(["why", path, TABLES, item, "--hero", hero, "--bought", item]) == 0 and "lambda" in capsys.readouterr().out
    assert cli.main(["why", path, TABLES, "no such item", "--hero", hero]) == 2 and "unknown" in capsys.readouterr().err
    assert cli.main(["heroes", TABLES]) == 0 and "share" in capsys.readouterr().out


def test_watch_follows_purchases(spark, tmp_path):
    levels = model(spark, [(1, 2, 3)] * 20)
    shop = spark.createDataFrame([(1, "One", 500), (2, "Two", 900), (3, "Three", 100)], "id long, name string, cost int")
    shares = spark.createDataFrame([(7, 0, 1.0)], "hero_id int, archetype_id int, share double")
    sinks.save_model(levels, shares, str(tmp_path / "m"), badge=None)
    told = []
    state = cli.watched(["one 1:10", "", "what", "Two 2:00"], advice.State(7, 0.0), sinks.load_model(spark, str(tmp_path / "m"))[0], shop, told.append)
    assert state.bought == (1, 2) and state.time_s == 120.0
    assert [t.split()[0] for t in (told[0], told[1], told[3])] == ["One", "Two", "Three"] and "unknown" in told[2]


def test_arguments():
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["next", "m", "f"])
    assert cli.parser().parse_args(["fit", "f", "m"]).badge == 80.0
