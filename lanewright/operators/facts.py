"""Fact tables from nested pulls: purchases with the state of their match, ability points, imbues.

A match is one document, so its players, samples and objectives are few
whatever the number of matches; everything that relates a purchase to the rest
of its match travels to it as small arrays in one join on the match.

Defined results: of a match pulled more than once the latest valid pull counts;
players whose result does not count give no rows; entries without a time or
that are no shop items are no purchases; samples without time or value do not
count; ids that are 0 are null; a match without the field of objectives has
``has_objectives`` false and no times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.operators import cleaning, points, ranking

#: Columns of the match and of the player that every purchase carries.
MATCH = ["average_badge", "duration_s", "has_objectives"]
STATE = ["kill_1", "kill_2", "kill_3", "boss_s"]


def seats(flat: dict[str, DataFrame]) -> DataFrame:
    """One row per player of the latest pulls whose result counts, with the match's fields."""
    match = flat["match"].select("match_id", "winning_team", "match_outcome", "average_badge", "duration_s", F.col("has_objectives").isNotNull().alias("has_objectives"))
    player = flat["player"].select(
        "match_id", F.col("doc"), F.col("pre").alias("player_pre"), "player_slot", "hero_id", "team", "account_id", "assigned_lane", "final_net_worth", "player_match_outcome",
        cleaning.known_id(F.col("hero_build_id")).alias("hero_build_id"), cleaning.known_id(F.col("pregame_hero_id")).alias("pregame_hero_id"),
    )
    won = cleaning.player_won(F.col("player_match_outcome"), F.col("team"), F.col("winning_team"), F.col("match_outcome"))
    return player.join(match, "match_id").withColumn("won", won).drop("winning_team", "match_outcome", "player_match_outcome")


def curves(stats: DataFrame) -> DataFrame:
    """(doc, player_pre, curve): each player's samples of net worth by time, from (0, 0)."""
    known = stats.where(F.col("time_stamp_s").isNotNull() & F.col("net_worth").isNotNull())
    dots = F.array_sort(F.collect_list(F.struct(F.col("time_stamp_s").cast("double").alias("t"), F.col("net_worth").cast("double").alias("w"))))
    return known.groupBy("doc", "player_pre").agg(dots.alias("curve"))


ORIGIN = "array<struct<t:double,w:double>>"


def from_origin(curve: Column) -> Column:
    """A curve that begins at (0, 0) if it would begin later; of a player without samples, that point alone."""
    start = F.array(F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("w"))).cast(ORIGIN)
    return F.when(curve.isNull() | (F.size(curve) == 0), start).when(curve[0]["t"] > 0, F.concat(start, curve)).otherwise(curve)


def on_curve(curve: Column, t: Column) -> Column:
    """The value at ``t`` on straight lines between samples, level before the first and after the last."""
    n = F.size(F.filter(curve, lambda x: x["t"] <= t))
    a, b = F.try_element_at(curve, F.greatest(n, F.lit(1))), F.try_element_at(curve, n + 1)
    rise = F.try_divide((b["w"] - a["w"]) * (t - a["t"]), b["t"] - a["t"])
    return a["w"] + F.when(n > 0, F.coalesce(rise, F.lit(0.0))).otherwise(0.0)


def _mean(xs: Column) -> Column:
    return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), F.size(xs))


def _median(xs: Column) -> Column:
    """Of a sorted array that is not empty."""
    n = F.size(xs)
    return (F.element_at(xs, F.floor((n + 1) / 2).cast("int")) + F.element_at(xs, F.floor((n + 2) / 2).cast("int"))) / 2


def purchases(flat: dict[str, DataFrame], shop: DataFrame) -> DataFrame:
    """(doc, player_pre, item_id, buy_time_s, buy_index, sold, sold_time_s, imbued_ability_id): shop items in order of time."""
    bought = flat["item"].where(F.col("game_time_s").isNotNull()).join(F.broadcast(shop.select(F.col("id").alias("item_id"))), "item_id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc", "player_pre").orderBy("game_time_s", "pos")) - 1
    sold = F.coalesce("sold_time_s", F.lit(0).cast("long"))
    return bought.select("doc", "player_pre", "item_id", F.col("game_time_s").alias("buy_time_s"), nth.alias("buy_index"), (sold != 0).alias("sold"), sold.alias("sold_time_s"))


def purchase_facts(flat: dict[str, DataFrame], shop: DataFrame) -> DataFrame:
    """One row per purchase of every player whose result counts, with the player's, the team's and the match's state then."""
    seat = seats(flat).join(curves(flat["stat"]), ["doc", "player_pre"], "left").withColumn("curve", from_origin(F.col("curve")))
    whole = seat.groupBy("match_id").agg(F.collect_list(F.struct("team", "curve")).alias("others"))
    state = cleaning.team_state(flat["objective"], flat["boss"])
    seat = seat.where(F.col("won").isNotNull()).join(state, ["match_id", "team"], "left")
    rows = purchases(flat, shop).join(seat, ["doc", "player_pre"]).join(whole, "match_id")
    t = F.col("buy_time_s").cast("double")
    then = F.transform("others", lambda o: F.struct(F.coalesce(o["team"] == F.col("team"), F.lit(False)).alias("own"), on_curve(o["curve"], t).alias("w")))
    rows = rows.withColumn("nw_at_buy", on_curve(F.col("curve"), t)).withColumn("then", then)
    worth = lambda keep: F.transform(F.filter("then", keep), lambda x: x["w"])
    safe = lambda c: F.when(c == 0, 1.0).otherwise(F.coalesce(c, F.lit(1.0)))
    nw = F.col("nw_at_buy")
    return rows.select(
        "match_id", "player_slot", "account_id", "hero_id", "team", "won", *MATCH, "assigned_lane", "final_net_worth", *STATE, "hero_build_id", "pregame_hero_id",
        "item_id", "buy_time_s", cleaning.phase_of(t).alias("phase"), "buy_index", "sold", "sold_time_s", "nw_at_buy",
        (nw / safe(_median(F.array_sort(worth(lambda x: F.lit(True)))))).alias("nw_vs_match_median"),
        (nw / safe(_mean(worth(lambda x: x["own"])))).alias("nw_vs_team_avg"), (nw / safe(_mean(worth(lambda x: ~x["own"])))).alias("nw_vs_enemy_avg"),
        (F.size(F.filter("then", lambda x: x["w"] < nw)) / F.greatest(F.size("then") - 1, F.lit(1))).alias("nw_rank_in_match"),
    )


def with_quintiles(facts: DataFrame) -> DataFrame:
    """The facts with ``nw_quintile``, the fifth of its phase in which a purchase's net worth lies (ties by match, seat and index)."""
    ranked = ranking.global_rank(facts, ["phase"], ["nw_at_buy", "match_id", "player_slot", "buy_index"])
    return ranked.withColumn("nw_quintile", ranking.quantile_bucket(F.col("rank"), F.col("rank_n"))).drop("rank", "rank_n")


def point_facts(flat: dict[str, DataFrame], shop: DataFrame, slots: DataFrame) -> DataFrame:
    """One row per ability point: entries that are no shop items, with the slot (hero_id, ability_id, signature_slot)
    of their ability (-1: none), the level their bit mask stands for, and ``step``, their place in the seat's order of time."""
    rest = flat["item"].where("item_id is not null").join(F.broadcast(shop.select(F.col("id").alias("item_id"))), "item_id", "left_anti")
    step = F.row_number().over(Window.partitionBy("doc", "player_pre").orderBy(F.coalesce("game_time_s", F.lit(0)), "pos")) - 1
    rows = rest.select("doc", "player_pre", F.col("item_id").alias("ability_id"), points.level_of(F.col("upgrade_info")).alias("level"), F.coalesce("game_time_s", F.lit(0)).alias("game_time_s"), step.alias("step"))
    seat = seats(flat).select("doc", "player_pre", "match_id", "player_slot", "hero_id", "average_badge")
    told = rows.join(seat, ["doc", "player_pre"]).join(slots, ["hero_id", "ability_id"], "left")
    return told.select("match_id", "player_slot", "hero_id", "average_badge", "ability_id", F.coalesce("signature_slot", F.lit(-1)).alias("signature_slot"), "level", "game_time_s", "step")


def imbue_facts(flat: dict[str, DataFrame], imbueable: DataFrame, slots: DataFrame) -> DataFrame:
    """One row per imbued purchase: items of ``imbueable`` (item_id, imbue_group) with a target, and the target's slot (-1: none)."""
    target = F.coalesce(cleaning.known_id(F.col("imbued_ability_id")), cleaning.known_id(F.col("imbue_target")))
    aimed = flat["item"].withColumn("ability_id", target).where(F.col("ability_id").isNotNull()).join(F.broadcast(imbueable), "item_id")
    seat = seats(flat).select("doc", "player_pre", "match_id", "player_slot", "hero_id")
    told = aimed.select("doc", "player_pre", "pos", "item_id", "imbue_group", "ability_id", F.coalesce("game_time_s", F.lit(0)).alias("game_time_s")).join(seat, ["doc", "player_pre"]).join(slots, ["hero_id", "ability_id"], "left")
    return told.select("match_id", "player_slot", "hero_id", "item_id", F.col("ability_id").alias("imbued_ability_id"), F.coalesce("signature_slot", F.lit(-1)).alias("signature_slot"), "imbue_group", "game_time_s")


def reconciled(flat: dict[str, DataFrame], shop: DataFrame) -> DataFrame:
    """(n_purchases, n_points, n_entries, ok): purchases and ability points must add up to all entries."""
    known = flat["item"].where("item_id is not null").join(F.broadcast(shop.select(F.col("id").alias("item_id"), F.lit(1).alias("shop"))), "item_id", "left")
    told = known.agg(F.count("shop").alias("n_purchases"), F.count(F.when(F.col("shop").isNull(), 1)).alias("n_points"), F.count(F.lit(1)).alias("n_entries"))
    return told.withColumn("ok", F.col("n_purchases") + F.col("n_points") == F.col("n_entries"))
