"""Which abilities players put items on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS = (1, 2, 3, 4)
#: Share from which a target has a majority, imbues below which it is thin.
MAJORITY, THIN = 0.5, 30


def imbue_entries(entries: DataFrame, shop: DataFrame, slots: DataFrame, keys: list[str]) -> DataFrame:
    """Item entries of imbueable items with a target; slot -1 where the ability has none.  Both dimensions are small."""
    kinds = shop.where("imbue is not null").select(F.col("id").alias("item_id"), F.col("imbue").alias("imbue_group"))
    hit = entries.where(F.coalesce("imbued_ability_id", F.lit(0)) != 0).join(F.broadcast(kinds), "item_id")
    return hit.join(F.broadcast(slots.select(F.col("ability_id").alias("imbued_ability_id"), "signature_slot")), "imbued_ability_id", "left").select(*keys, "item_id", "imbued_ability_id", F.coalesce("signature_slot", F.lit(-1)).alias("signature_slot"), "imbue_group", "game_time_s")


def item_direction(rows: DataFrame, players: DataFrame, keys: list[str]) -> DataFrame:
    """(hero_id, item_id, purchases, buyers, buy_rate, top_slot, top_share, entropy) of mapped imbues."""
    known = rows.where(F.col("signature_slot").isin(*SLOTS))
    n_players = players.groupBy("hero_id").agg(F.count(F.lit(1)).alias("_players"))
    buyers = known.select("hero_id", "item_id", *keys).distinct().groupBy("hero_id", "item_id").agg(F.count(F.lit(1)).alias("buyers"))
    slots = known.groupBy("hero_id", "item_id", "signature_slot").agg(F.count(F.lit(1)).alias("n"))
    share = slots.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("hero_id", "item_id")))
    told = share.groupBy("hero_id", "item_id").agg(F.sum("n").alias("purchases"), F.max_by("signature_slot", F.struct("n", -F.col("signature_slot"))).alias("top_slot"), F.max("p").alias("top_share"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
    return told.join(buyers, ["hero_id", "item_id"]).join(n_players, "hero_id").select("hero_id", "item_id", "purchases", "buyers", (F.col("buyers") / F.col("_players")).alias("buy_rate"), "top_slot", "top_share", "entropy")


def imbue_rate(rows: DataFrame, players: DataFrame, keys: list[str]) -> DataFrame:
    """(hero_id, rate): share of a hero's players who imbued anything; 0 where nobody did."""
    did = rows.select("hero_id", *keys).distinct().groupBy("hero_id").agg(F.count(F.lit(1)).alias("_n"))
    return players.groupBy("hero_id").agg(F.count(F.lit(1)).alias("_all")).join(did, "hero_id", "left").select("hero_id", (F.coalesce("_n", F.lit(0)) / F.col("_all")).alias("rate"))


def contested(directions: DataFrame, min_purchases: int = 300, min_buy_rate: float = 0.2, min_entropy: float = 0.8) -> DataFrame:
    return directions.where((F.col("purchases") >= min_purchases) & (F.col("buy_rate") >= min_buy_rate) & (F.col("entropy") >= min_entropy))


def gated_heroes(directions: DataFrame, rates: DataFrame, min_rate: float = 0.5, **limits: float) -> DataFrame:
    """(hero_id): heroes with a contested item and enough imbuers."""
    return contested(directions, **limits).select("hero_id").distinct().join(rates.where(F.col("rate") >= min_rate), "hero_id").select("hero_id")


def imbue_features(rows: DataFrame, players: DataFrame, keys: list[str]) -> DataFrame:
    """Per player: share of each slot within each group of imbues, depth = min(n / 4, 1), and whether there are any."""
    known = F.col("signature_slot").isin(*SLOTS)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    shares = [F.coalesce(F.try_divide(one((F.col("imbue_group") == g) & (F.col("signature_slot") == s)), one((F.col("imbue_group") == g) & known)), F.lit(0.0)).alias(f"{g}_{s}") for g in ("active", "modifier") for s in SLOTS]
    n = one(known)
    wide = rows.groupBy(*keys).agg(*shares, F.least(n / 4, F.lit(1.0)).alias("depth"), F.when(n > 0, 1).otherwise(0).alias("has_imbue"))
    filled = [c for c in wide.columns if c not in keys]
    return players.select(*keys).distinct().join(wide, keys, "left").fillna(0, filled)


def conditional_features(features: DataFrame, players: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of imbuers; players without imbue get their hero's mean over imbuers (0 if there is none)."""
    columns = [c for c in features.columns if c not in (*keys, "depth", "has_imbue")]
    rows = features.join(players.select("hero_id", *keys).distinct(), keys)
    means = rows.where("has_imbue = 1").groupBy("hero_id").agg(*(F.avg(c).alias(f"_{c}") for c in columns))
    return rows.join(means, "hero_id", "left").select(*keys, *(F.when(F.col("has_imbue") == 1, F.col(c)).otherwise(F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in columns))


def usual_targets(rows: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group, item_id, ability_id, n, share): the commonest target of each item, the smallest id on a tie."""
    keys = [*(group or []), "item_id"]
    counts = rows.groupBy(*keys, "imbued_ability_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by("imbued_ability_id", F.struct("n", -F.col("imbued_ability_id"))).alias("ability_id"), F.max("n").alias("n"), (F.max("n") / F.sum("n")).alias("share"))


def targets_of_build(build: DataFrame, targets: DataFrame, shop: DataFrame) -> DataFrame:
    """(pos, item_id, ability_id, n, share, split, thin) of a build's imbueable items, each at its first place; null where
    nobody imbued it.  ``split``: the commonest target has no majority; ``thin``: few imbues back it."""
    first = build.groupBy("item_id").agg(F.min("pos").alias("pos"))
    able = first.join(F.broadcast(shop.where("imbue is not null").select(F.col("id").alias("item_id"))), "item_id", "left_semi")
    return able.join(targets, "item_id", "left").select("pos", "item_id", "ability_id", F.coalesce("n", F.lit(0)).alias("n"), "share", (F.col("ability_id").isNotNull() & (F.col("share") < MAJORITY)).alias("split"), (F.col("ability_id").isNotNull() & (F.col("n") < THIN)).alias("thin"))
