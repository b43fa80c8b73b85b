"""Names of groups of players: the ability or item they stand for, and names that differ within a hero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows, share and excess over the hero's other groups from which a slot is a group's focus.
FOCUS_ROWS, FOCUS_SHARE, FOCUS_LIFT = 30, 0.5, 0.2


def dominant_slot(rows: DataFrame, cell: list[str], within: list[str], slot: str = "signature_slot", least: int = FOCUS_ROWS, share: float = FOCUS_SHARE, lift: float = FOCUS_LIFT) -> DataFrame:
    """(cell, slot, lift): the commonest slot of each cell (the smaller on a tie) if it has enough rows, a large
    share of them, and stands out against the other cells of ``within``."""
    counts = rows.groupBy(*cell, slot).agg(F.count(F.lit(1)).alias("_n"))
    own, hero = Window.partitionBy(*cell), Window.partitionBy(*within)
    told = counts.withColumn("_own", F.sum("_n").over(own)).withColumn("_hero", F.sum("_n").over(hero)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*within, slot)))
    elsewhere = F.coalesce(F.try_divide(F.col("_all") - F.col("_n"), F.col("_hero") - F.col("_own")), F.lit(0.0))
    told = told.withColumn("_share", F.col("_n") / F.col("_own")).withColumn("lift", F.round(F.col("_share") - elsewhere, 9)).withColumn("_p", F.row_number().over(own.orderBy(F.desc("_n"), slot)))
    return told.where((F.col("_p") == 1) & (F.col("_own") >= least) & (F.col("_share") >= share) & (F.col("lift") >= lift)).select(*cell, F.col(slot).alias("slot"), "lift")


def ability_focus(imbues: DataFrame, maxed: DataFrame, labels: DataFrame, keys: list[str], **limits) -> DataFrame:
    """(hero_id, archetype_id, slot, lift): the slot a group centres on, by what it imbues, else by what it maxes first.
    ``limits``: those of ``dominant_slot``."""
    cell = ["hero_id", "archetype_id"]
    own = lambda rows, slot: rows.join(labels.select(*keys, "archetype_id"), keys).select(*cell, F.col(slot).alias("signature_slot"))
    first = dominant_slot(own(imbues, "signature_slot"), cell, ["hero_id"], **limits)
    second = dominant_slot(own(maxed.where("first_maxed > 0"), "first_maxed"), cell, ["hero_id"], **limits)
    return first.unionByName(second.join(first.select(*cell), cell, "left_anti"))


def focus_label(slot: Column, name: Column) -> Column:
    """The word for a slot: the last is the "Ult", others go by their ability's name."""
    return F.when(slot == 4, "Ult").otherwise(F.coalesce(name, F.concat(F.lit("Slot "), slot.cast("string"))))


def item_label(distinctive: DataFrame, shop: DataFrame) -> DataFrame:
    """(hero_id, archetype_id, item): last word of the name of each group's most distinctive item (place 1)."""
    best = distinctive.where("place = 1").join(F.broadcast(shop.select(F.col("id").alias("item_id"), "name")), "item_id")
    return best.select("hero_id", "archetype_id", F.element_at(F.split(F.trim("name"), r"\s+"), -1).alias("item")).where("item <> ''")


def unique_names(proposed: DataFrame, hero: str = "hero_id", cluster: str = "archetype_id") -> DataFrame:
    """``proposed`` (hero, cluster, name, focus, item, fixed) with ``unique``: names that differ within a hero.

    ``fixed`` names stay.  Groups that share a name get their focus before it, if all have one and all differ; else
    their item, likewise; else a number after it.  A name that still occurs twice gets a number, fixed ones first.
    Two equal fixed names of one hero are an error."""
    clash = proposed.where("fixed is not null").groupBy(hero, "fixed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if clash:
        raise ValueError(f"hero {clash[0][hero]}: the name {clash[0]['fixed']!r} is fixed for two groups")
    rows = proposed.withColumn("_name", F.coalesce("fixed", "name")).withColumn("_free", F.col("fixed").isNull())
    alike = Window.partitionBy(hero, "_name")
    n, free = F.count(F.lit(1)).over(alike), F.sum(F.col("_free").cast("int")).over(alike)
    for source in ("focus", "item"):
        rows = rows.withColumn(f"_{source}", F.size(F.collect_set(F.when(F.col("_free"), F.nullif(F.col(source), F.lit("")))).over(alike)) == free)
    number = F.row_number().over(Window.partitionBy(hero, "_name", "_free").orderBy(cluster)).cast("string")
    label = F.when((n < 2) | ~F.col("_free"), F.col("_name")).when(F.col("_focus"), F.concat_ws(" ", "focus", "_name")).when(F.col("_item"), F.concat_ws(" ", "item", "_name")).otherwise(F.concat_ws(" ", F.col("_name"), number))
    rows = rows.withColumn("_label", label)
    again = F.row_number().over(Window.partitionBy(hero, "_label").orderBy("_free", cluster))
    return rows.withColumn("unique", F.when(again > 1, F.concat_ws(" ", F.col("_label"), again.cast("string"))).otherwise(F.col("_label"))).drop("_name", "_free", "_focus", "_item", "_label")
