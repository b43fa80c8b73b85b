"""Ability points: levels, orders, timings, and what upgrades were open when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = (1, 2, 3, 4)
#: Points an upgrade costs, by the level it reaches.
LEVEL_COST = {2: 1, 3: 2, 4: 5}


def level_of(upgrade_info: Column) -> Column:
    """Level from the bit mask in the upper half: 1, 3, 7, 15 are levels 1 to 4, all else 0."""
    bits = F.shiftright(upgrade_info, 16)
    return F.when(bits == 1, 1).when(bits == 3, 2).when(bits == 7, 3).when(bits == 15, 4).otherwise(0)


def levels_at(points: DataFrame, keys: list[str], until: float) -> DataFrame:
    """(keys, lvl_1..lvl_4, first_slot): highest level of each slot by ``until`` (0: none) and
    the slot of the first mapped point; every player is kept."""
    early = F.col("game_time_s") <= until
    levels = [F.coalesce(F.max(F.when(early & (F.col("signature_slot") == s), F.col("level"))), F.lit(0)).alias(f"lvl_{s}") for s in SLOTS]
    first = F.min(F.when(early & (F.col("signature_slot") > 0), F.struct("game_time_s", "step", "signature_slot")))
    return points.groupBy(*keys).agg(*levels, F.coalesce(first["signature_slot"], F.lit(0)).alias("first_slot"))


def slot_order(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, order_1..order_4): in which order the slots got their first point; 0 for none."""
    first = {s: F.min(F.when((F.col("level") >= 1) & (F.col("signature_slot") == s), F.struct("game_time_s", "step"))).alias(f"_{s}") for s in SLOTS}
    # a null is before nothing
    before = lambda a, b: F.coalesce((F.col(f"_{a}") <= F.col(f"_{b}") if a < b else F.col(f"_{a}") < F.col(f"_{b}")).cast("int"), F.lit(0))
    nth = lambda s: sum((before(other, s) for other in SLOTS if other != s), F.lit(1))
    return points.groupBy(*keys).agg(*first.values()).select(*keys, *(F.when(F.col(f"_{s}").isNull(), 0).otherwise(nth(s)).alias(f"order_{s}") for s in SLOTS))


def point_order(points: DataFrame, keys: list[str], levels: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(keys, pt_s_lL): share of the player's points spent before slot s reached level L; 1 for never.

    Points without slot count as points."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("game_time_s", "step")) - 1
    numbered = points.withColumn("_at", at)
    n = F.count(F.lit(1))
    columns = [F.coalesce(F.min(F.when((F.col("signature_slot") == s) & (F.col("level") >= L), F.col("_at"))) / n, F.lit(1.0)).alias(f"pt_{s}_l{L}") for s in SLOTS for L in levels]
    return numbered.groupBy(*keys).agg(*columns)


def less_mean(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Columns less their group means; the means are aggregated, then joined, so no group sits in one task."""
    means = df.groupBy(*group).agg(*(F.avg(c).alias(f"_{c}") for c in columns))
    return df.join(means, group).select(*(c for c in df.columns if c not in columns), *((F.col(c) - F.col(f"_{c}")).alias(c) for c in columns))


def centred_rank(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """``column`` as its share rank within the group (ties get their mean rank) less one half.

    Ranks come from counts by value, so what is windowed is distinct values, not rows."""
    counts = df.groupBy(*group, column).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group)
    ranks = counts.select(*group, column, ((F.sum("_n").over(w.orderBy(column)) - F.col("_n") + (F.col("_n") + 1) / 2) / F.sum("_n").over(w) - 0.5).alias("_rank"))
    return df.join(ranks, [*group, column]).withColumn(column, F.col("_rank")).select(*df.columns)


def first_maxed(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_maxed): slot of the earliest point that reached level 4; 0 for none."""
    top = F.min(F.when((F.col("level") >= 4) & (F.col("signature_slot") > 0), F.struct("game_time_s", "step", "signature_slot")))
    return points.groupBy(*keys).agg(F.coalesce(top["signature_slot"], F.lit(0)).alias("first_maxed"))


def as_sequence(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points in the shape of purchases: mapped slots as items, renumbered without gaps."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("game_time_s", "step")) - 1
    return points.where(F.col("signature_slot") > 0).withColumn("_at", at).select(*keys, "hero_id", "average_badge", F.col("signature_slot").cast("long").alias("item_id"), F.col("game_time_s").alias("buy_time_s"), F.col("_at").alias("step"))


def weighted_median(df: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """(group, median): the first value whose running weight reaches half of the total.

    Weights are added up by value first, so the window runs over distinct values."""
    summed = df.groupBy(*group, F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*group)
    upto, total = F.sum("w").over(w.orderBy("v")), F.sum("w").over(w)
    return summed.select(*group, "v", upto.alias("upto"), total.alias("total")).where((F.col("total") > 0) & (F.col("upto") >= F.col("total") / 2)).groupBy(*group).agg(F.min("v").alias("median"))


def level_at(events: DataFrame, points: DataFrame, keys: list[str], time: str = "game_time_s") -> DataFrame:
    """``events`` with ``level_then``: the highest level that the event's slot had by its time (0: none).

    An as-of join backwards in time; as levels only rise, it is a maximum over an equi-join."""
    own = points.select(*keys, "signature_slot", F.col("level").alias("_level"), F.col("game_time_s").alias("_since"))
    marked = events.withColumn("_id", F.struct(*events.columns))
    got = marked.join(own, [*keys, "signature_slot"]).where(F.col("_since") <= F.col(time)).groupBy("_id").agg(F.max("_level").alias("_then"))
    return marked.join(got, "_id", "left").select(*events.columns, F.coalesce("_then", F.lit(0)).alias("level_then"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, name: str) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` at or before its time, by one sweep per key."""
    both = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v")).unionByName(
        right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"), F.col(value).alias("_v"))
    )
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", name)


def exposure(ordered: DataFrame, keys: list[str], levels: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """Long (keys, slot, level, e): for how much of the player's points a tier was open."""
    parts = ", ".join(f"{s}, {L}, 1 - pt_{s}_l{L}" for s in SLOTS for L in levels)
    return ordered.select(*keys, F.expr(f"stack({len(SLOTS) * len(levels)}, {parts}) as (slot, level, e)"))


def effect_shares(exposed: DataFrame, effects: DataFrame, keys: list[str], hero: str = "hero_id") -> DataFrame:
    """(keys, category, e): mean exposure over the tiers of the hero (hero, slot, level, category) that unlock it."""
    return exposed.join(effects, [hero, "slot", "level"]).groupBy(*keys, "category").agg(F.avg("e").alias("e"))


def routed_share(exposed: DataFrame, routed: DataFrame, keys: list[str], hero: str = "hero_id") -> DataFrame:
    """(keys, w): cost-weighted share of exposure that lies in routed slots (hero, slot); 0 for none."""
    cost = F.coalesce(*(F.when(F.col("level") == level, c) for level, c in LEVEL_COST.items()))
    mark = routed.select(hero, "slot").distinct().withColumn("_r", F.lit(1))
    rows = exposed.join(mark, [hero, "slot"], "left").withColumn("_c", cost * F.col("e"))
    return rows.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("_r") == 1, F.col("_c")).otherwise(0.0)), F.sum("_c")), F.lit(0.0)).alias("w"))


def reroute(shares: DataFrame, weight: Column, source: str = "spirit", target: str = "gun") -> DataFrame:
    """Moves the share ``weight`` of one family to another; row sums stay."""
    moved = F.col(source) * weight
    return shares.withColumn(target, F.col(target) + moved).withColumn(source, F.col(source) - moved)
