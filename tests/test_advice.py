import pytest
from pyspark.sql import functions as F

from lanewright.operators import advice, backoff, imbues, kits, naming, points, upgrades
from tests.conftest import rows

SEAT = ["match_id", "player_slot"]


def model(spark, orders):
    data = [(m, 1, 7, x, i, 100.0 * i) for m, items in enumerate(orders) for i, x in enumerate(items)]
    df = spark.createDataFrame(data, "match_id long, player_slot int, hero_id int, item_id long, step int, buy_time_s double")
    labels = df.select(*SEAT).distinct().withColumn("archetype_id", (F.col("match_id") % 2).cast("int"))
    return backoff.levels(backoff.prepared(df, labels, SEAT))


def test_advice_follows_the_state(spark):
    table = model(spark, [(1, 2, 3)] * 20 + [(1, 3, 2)] * 4)
    shop = spark.createDataFrame([(1, "One", 500), (2, "Two", 900), (3, "Three", None)], "id long, name string, cost int")
    state = advice.State(7, 100.0, bought=(1,), shares={0: 0.75, 1: 0.25})
    got = advice.advise(state, table, shop).collect()
    assert [(r["place"], r["name"]) for r in got] == [(1, "Two"), (2, "Three")] and sum(r["p"] for r in got) == pytest.approx(1)
    assert got[0]["thin"] and got[0]["level"] == "last two" and got[0]["n"] == 10
    assert [r["name"] for r in advice.advise(advice.State(7, 100.0, souls=600, bought=(1,)), table, shop).collect()] == ["Three"]
    later = state.after(2, 200.0)
    assert (later.bought, later.time_s, later.bucket, state.bucket) == ((1, 2), 200.0, 0, 0) and advice.State(7, 900.0).bucket == 3
    assert [r["item_id"] for r in advice.advise(later, table, shop, 1).collect()] == [3]
    lines = advice.explained(state, table, 2).collect()
    assert [r["level"] for r in lines] == [0, 1, 2, 3, 4, 5] and lines[0]["local"] == pytest.approx(10 / 12) and lines[0]["n"] == 12
    assert lines[0]["part"] == pytest.approx(12 / 32 * 10 / 12) and lines[0]["lambda"] == pytest.approx(12 / 32)
    unseen = advice.explained(advice.State(8, 0.0), table, 2).collect()
    assert len(unseen) == 6 and all(r["part"] == 0 and r["n"] == 0 for r in unseen)


def test_point_advice_leaves_full_slots_out(spark):
    table = model(spark, [(1, 1, 1, 1, 2, 3)] * 10)
    slots = spark.createDataFrame([(1, "Fire"), (2, "Ice"), (3, "Dash"), (4, "Storm")], "signature_slot int, name string")
    got = advice.advise_points(advice.State(7, 400.0, bought=(1, 1, 1, 1)), table, slots, {1: 4}).collect()
    assert [(r["slot"], r["level"]) for r in got] == [(2, 1), (3, 1)]
    line = spark.range(1).select(advice.point_line(F.lit(0), F.lit("Fire"), F.lit(1), F.lit(125.0), F.lit(0.5), F.lit(12))).first()[0]
    assert line == " 1. Fire                   -> level 1  ~2min  p=0.500 (n=12)  [thin]"


def test_badges(spark):
    assert advice.target_badge(" All ") is None and advice.target_badge("80") == 80.0
    assert advice.badge_label(None) == "all badges" and advice.badge_label(80.0) == "badge ~80"
    ranks = spark.createDataFrame([(8, "Eighth"), (0, "None")], "tier int, name string")
    df = spark.createDataFrame([(1, 83), (2, 9), (3, 120), (4, None)], "id int, average_badge int")
    assert rows(advice.with_tier_names(df, ranks), "id", "tier", "tier_name") == [(1, 8, "Eighth"), (2, 0, "None"), (3, 12, None), (4, None, None)]


ABILITY = """id long, hero long, name string, properties map<string,struct<value:string,provided_property_type:string,scale_function:struct<specific_stat_scale_type:string,class_name:string>>>,
upgrades array<struct<property_upgrades:array<struct<name:string,bonus:string>>>>"""
RULES = upgrades.Rules(ignored=("Tick",), barred="Slow", named="PerBullet", broad="bullet|fire", types=("FIRE_RATE",), categories=(("control", "slow|stun"), ("damage", "damage")), scale_types=("ESpirit",), scale_classes=("scale_spirit",))


def prop(value, kind=None, scale=None, klass=None):
    return (value, kind, (scale, klass))


def test_ability_table(spark):
    tier = lambda *names: ([*names],)
    data = [
        (10, 1, "Set", {"DamagePerBullet": prop("5", scale="ESpirit")}, [tier(("StunTime", "1"), ("Damage", "2"))]),
        (11, 1, "Granted", {"DamagePerBullet": prop("0"), "Rate": prop("0", "FIRE_RATE")}, [tier(("Damage", "2")), tier(("Rate", "10"), ("Tick", "1"))]),
        (12, 1, "Barred", {"SlowPerBullet": prop("5"), "Rate": prop(None, klass="scale_spirit")}, None),
        (13, 2, "Word", {"UnlimitedPerBullet": prop("yes")}, []),
        (14, 2, "Zero", {"DamagePerBullet": prop("0")}, [tier(("DamagePerBullet", "0"))]),
        (15, 2, "Bare", None, None),
        (16, None, "Nobody", {"DamagePerBullet": prop("5")}, None),
    ]
    slots = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 13, 4)], "hero_id long, ability_id long, signature_slot int")
    table = upgrades.ability_table(spark.createDataFrame(data, ABILITY), slots, RULES)
    got = {r["ability_id"]: r for r in table.collect()}
    assert {i: r["weapon_tier"] for i, r in got.items()} == {10: 0, 11: 2, 12: -1, 13: 0, 14: -1, 15: -1}
    assert {i for i, r in got.items() if r["spirit_scaling"]} == {10, 12} and {i for i, r in got.items() if r["weapon_listed"]} == {10, 11, 13, 14}
    assert {i for i, r in got.items() if r["weapon_broad"]} == {10, 11, 12, 13, 14}
    assert (got[10]["cats_l2"], got[10]["cats_l3"], got[11]["cats_l3"], got[15]["cats_l2"], got[15]["n_tiers"]) == (["control", "damage"], [], ["other", "weapon"], [], 0)
    assert rows(upgrades.routed_slots(table)) == [(1, 1)]
    assert rows(upgrades.tier_effects(table)) == [(1, 1, 2, "control"), (1, 1, 2, "damage"), (1, 2, 2, "damage"), (1, 2, 3, "other"), (1, 2, 3, "weapon")]
    shares = spark.createDataFrame([(5, 1, 0.6), (6, 1, 0.5)], "match_id long, player_slot int, spirit double")
    exposure = spark.createDataFrame([(5, 1, 0.5)], "match_id long, player_slot int, w double")
    assert rows(upgrades.routed_block(shares, exposure, SEAT)) == [(5, 1, pytest.approx(0.3)), (6, 1, 0.0)]


def test_exposure_is_the_mean_over_tiers(spark):
    ordered = spark.createDataFrame([(5, 1, 7, *[s / 10 + L / 100 for s in (1, 2, 3, 4) for L in (2, 3, 4)])], "match_id long, player_slot int, hero_id long, " + ", ".join(f"pt_{s}_l{L} double" for s in (1, 2, 3, 4) for L in (2, 3, 4)))
    exposed = points.exposure(ordered, [*SEAT, "hero_id"])
    effects = spark.createDataFrame([(7, 1, 2, "shred"), (7, 3, 4, "shred"), (8, 1, 2, "area")], "hero_id long, slot int, level int, category string")
    assert rows(points.effect_shares(exposed, effects, SEAT)) == [(5, 1, "shred", pytest.approx((0.88 + 0.66) / 2))]


def test_kits(spark):
    data = [(1, ("Burns <b>foes</b>. It explodes.", None, None)), (2, ("  ", "Burns and blasts", None)), (3, (None, None, "Heals an ally")), (4, None), (5, (None, " ", None))]
    df = spark.createDataFrame(data, "id long, description struct<desc:string,active:string,passive:string>")
    tags = kits.ability_tags(df, {"dot": r"\bburns", "burst": "explode|blast", "support": "heals.*ally"}, {"burst": ("dot", "explode")})
    assert rows(tags) == [(1, "burst"), (1, "dot"), (2, "dot"), (3, "support")]
    slots = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (8, 3, 1), (9, 1, 1)], "hero_id long, ability_id long, signature_slot int")
    heroes = spark.createDataFrame([(7, "Ash"), (8, "Birch")], "hero_id long, name string")
    kit = kits.hero_kits(tags, slots, heroes)
    assert rows(kit) == [(7, "burst", 1), (7, "dot", 2), (8, "support", 1)]
    assert rows(kits.heroes_by_tag(kit, heroes, "dot")) == [("Ash", 2)]
    assert rows(kits.kit_families(kit, {"support": ("support", 3), "burst": ("spirit", 2)})) == [(7, "spirit", 2), (8, "support", 3)]


def test_focus_needs_rows_share_and_lift(spark):
    def seats(hero, archetype, slots):
        return [(hero, archetype, s) for s, n in slots.items() for _ in range(n)]

    data = [*seats(1, 0, {4: 30, 1: 10}), *seats(1, 1, {1: 40}), *seats(2, 0, {2: 40}), *seats(2, 1, {2: 40}), *seats(3, 0, {3: 20}), *seats(3, 1, {1: 60})]
    labels = spark.createDataFrame([(i, 1, a) for i, (_, a, _) in enumerate(data)], "match_id long, player_slot int, archetype_id int")
    aimed = spark.createDataFrame([(i, 1, h, s) for i, (h, _, s) in enumerate(data)], "match_id long, player_slot int, hero_id int, signature_slot int")
    maxed = spark.createDataFrame([(i, 1, h, 2 if h == 3 and a == 0 else 0) for i, (h, a, _) in enumerate(data * 2)], "match_id long, player_slot int, hero_id int, first_maxed int").where("match_id < 240")
    got = rows(naming.ability_focus(aimed, maxed, labels, SEAT))
    assert got == [(1, 0, 4, 0.75), (1, 1, 1, 0.75), (3, 1, 1, 1.0)]
    label = spark.createDataFrame([(4, "Storm"), (1, "Fire"), (2, None)], "s int, n string").select(naming.focus_label(F.col("s"), F.col("n"))).collect()
    assert [r[0] for r in label] == ["Ult", "Fire", "Slot 2"]


def test_unique_names(spark):
    schema = "hero_id int, archetype_id int, name string, focus string, item string, fixed string"
    data = [
        (1, 0, "Gun Ash", "Ult", None, None), (1, 1, "Gun Ash", "Fire", None, None),  # focus tells them apart
        (2, 0, "Gun Fir", "Ult", "Echo", None), (2, 1, "Gun Fir", None, "Ring", None),  # items do
        (3, 0, "Gun Oak", None, None, None), (3, 1, "Gun Oak", "Ult", None, None),  # nothing does
        (4, 0, "Gun Elm", None, None, "Mine"), (4, 1, "Mine", None, None, None),  # the fixed one keeps its name
        (5, 0, "Only", "Ult", "Echo", None),
    ]
    got = rows(naming.unique_names(spark.createDataFrame(data, schema)), "hero_id", "archetype_id", "unique")
    assert got == [(1, 0, "Ult Gun Ash"), (1, 1, "Fire Gun Ash"), (2, 0, "Echo Gun Fir"), (2, 1, "Ring Gun Fir"), (3, 0, "Gun Oak 1"), (3, 1, "Gun Oak 2"), (4, 0, "Mine"), (4, 1, "Mine 1"), (5, 0, "Only")]
    with pytest.raises(ValueError, match="hero 1"):
        naming.unique_names(spark.createDataFrame([(1, 0, "a", None, None, "X"), (1, 1, "b", None, None, "X")], schema))
    items = spark.createDataFrame([(9, "Mystic Echo ")], "id long, name string")
    best = spark.createDataFrame([(1, 0, 1, 9), (1, 1, 2, 9)], "hero_id int, archetype_id int, place int, item_id long")
    assert rows(naming.item_label(best, items)) == [(1, 0, "Echo")]


def test_targets_of_a_build(spark):
    build = spark.createDataFrame([(1, 900), (2, 901), (3, 902), (4, 900)], "pos int, item_id long")
    targets = spark.createDataFrame([(900, 5, 40, 0.4), (901, 6, 10, 0.9)], "item_id long, ability_id long, n long, share double")
    shop = spark.createDataFrame([(900, "active"), (901, "active"), (902, "active"), (903, None)], "id long, imbue string")
    assert rows(imbues.targets_of_build(build, targets, shop)) == [(1, 900, 5, 40, 0.4, True, False), (2, 901, 6, 10, 0.9, False, True), (3, 902, None, 0, None, False, False)]
