"""What players buy against an enemy more often than they buy it anyway."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewright.operators.splitting import replication

#: Least players facing the enemy, least lift.
MIN_FACING, MIN_LIFT = 500, 0.03


def enemy_rosters(bought: DataFrame) -> DataFrame:
    """(match_id, player_slot, enemy_hero_id): a row per player and distinct enemy hero."""
    roster = bought.select("match_id", "player_slot", "team", "hero_id").where(F.col("team").isNotNull()).distinct()
    other = roster.select("match_id", F.col("team").alias("enemy_team"), F.col("hero_id").alias("enemy_hero_id"))
    return roster.join(other, "match_id").where(F.col("team") != F.col("enemy_team")).select("match_id", "player_slot", "enemy_hero_id").distinct()


def counter_lifts(bought: DataFrame, min_facing: int = MIN_FACING, min_lift: float = MIN_LIFT) -> DataFrame:
    """(item_id, enemy_hero_id, facing_rate, baseline_rate, lift, n_facing).

    The many-to-many join stays within a player; what is aggregated combines on the map side."""
    keys = ["match_id", "player_slot"]
    facing = enemy_rosters(bought)
    owned = bought.select(*keys, "item_id").distinct()
    players = bought.select(*keys).distinct().count()
    base = owned.groupBy("item_id").agg((F.count(F.lit(1)) / F.lit(max(players, 1))).alias("baseline_rate"))
    n_facing = facing.groupBy("enemy_hero_id").agg(F.count(F.lit(1)).alias("n_facing")).where(F.col("n_facing") >= min_facing)
    both = facing.join(owned, keys).groupBy("enemy_hero_id", "item_id").agg(F.count(F.lit(1)).alias("_n"))
    rates = both.join(n_facing, "enemy_hero_id").join(base, "item_id").withColumn("facing_rate", F.col("_n") / F.col("n_facing"))
    return rates.withColumn("lift", F.col("facing_rate") - F.col("baseline_rate")).where(F.col("lift") >= min_lift).select("item_id", "enemy_hero_id", "facing_rate", "baseline_rate", "lift", "n_facing")


def best_counters(lifts: DataFrame, per: str = "item_id") -> DataFrame:
    """The strongest row of each item (ties to the smaller hero)."""
    place = F.row_number().over(Window.partitionBy(per).orderBy(F.desc(F.round("lift", 9)), "enemy_hero_id"))
    return lifts.withColumn("_p", place).where("_p = 1").drop("_p")


def counters_for(lifts: DataFrame, enemies: list[int]) -> DataFrame:
    return best_counters(lifts.where(F.col("enemy_hero_id").isin(enemies)))


def counters_of_build(lifts: DataFrame, build: DataFrame, limit: int = 8) -> DataFrame:
    """Of a build's items (item_id) the strongest counter each, the ``limit`` strongest of them."""
    return best_counters(lifts.join(build.select("item_id").distinct(), "item_id", "left_semi")).orderBy(F.desc(F.round("lift", 9)), "item_id").limit(limit)


def annotated(recommended: DataFrame, lifts: DataFrame, enemies: list[int]) -> DataFrame:
    """Recommendations with their best counter, order and number unchanged."""
    best = counters_for(lifts, enemies).select("item_id", "enemy_hero_id", "lift")
    return recommended.join(best, "item_id", "left")


def replicates(first: DataFrame, second: DataFrame, min_facing: int = MIN_FACING) -> DataFrame:
    """(n, r): correlation of the lifts of two disjoint sets of purchases, over what both measure; null below three."""
    a, b = (counter_lifts(half, min_facing, -1.0) for half in (first, second))
    return replication(a, b, ["item_id", "enemy_hero_id"], "lift")


def described(counters: DataFrame, heroes: DataFrame) -> DataFrame:
    """``counters`` with ``text``: by how many points an item is bought more often against a hero (hero_id, name)."""
    names = heroes.select(F.col("hero_id").alias("enemy_hero_id"), F.col("name").alias("_enemy"))
    line = F.format_string("%+.1f points against %s (n=%d)", F.col("lift") * 100, F.coalesce("_enemy", F.col("enemy_hero_id").cast("string")), "n_facing")
    return counters.join(F.broadcast(names), "enemy_hero_id", "left").withColumn("text", line).drop("_enemy")
