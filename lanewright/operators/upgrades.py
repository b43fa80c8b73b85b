"""What ability upgrades do: which work through the gun, which scale with spirit, and their categories.

An ability is one row with its properties as a map and its upgrades as an
array; everything is told by expressions over these, so nothing is shuffled.
The rules are names and patterns of the game's data and are passed in.

Defined results: an ability without properties or upgrades has no tier and no
category; a property that is not a record is taken as absent; a value that is
no number counts as set, an absent bonus as zero.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.functions.text import leading_number

LEVELS = (2, 3, 4)


class Rules(NamedTuple):
    """``ignored``: names that say nothing; ``barred``, ``named``, ``broad``: patterns of names (``broad`` any case);
    ``types``: kinds of properties that make an ability work through the gun; ``categories``: pattern of each
    category, the first that matches counts, any case; ``scale_types``, ``scale_classes``: what marks spirit scaling."""

    ignored: tuple[str, ...] = ()
    barred: str = "(?!)"
    named: str = "(?!)"
    broad: str = "(?!)"
    types: tuple[str, ...] = ()
    categories: tuple[tuple[str, str], ...] = ()
    scale_types: tuple[str, ...] = ()
    scale_classes: tuple[str, ...] = ()


def through_gun(name: Column, prop: Column, rules: Rules) -> Column:
    """Whether a property makes its ability work through the gun."""
    typed = F.coalesce(prop["provided_property_type"].isin(*rules.types), F.lit(False)) if rules.types else F.lit(False)
    barred = (name.isin(*rules.ignored) if rules.ignored else F.lit(False)) | name.rlike(rules.barred)
    return ~barred & (typed | name.rlike(rules.named))


def is_set(prop: Column) -> Column:
    """Whether a base property has a value: one that is not zero, or is no number."""
    number = leading_number(prop["value"])
    return prop.isNotNull() & (number.isNull() | (number != 0))


def category(name: Column, prop: Column, rules: Rules) -> Column:
    """The category of an upgraded property: ``weapon``, the first whose pattern matches, else ``other``."""
    out = F.when(through_gun(name, prop, rules), "weapon")
    for kind, pattern in rules.categories:
        out = out.when(name.rlike(f"(?i){pattern}"), kind)
    return out.otherwise("other")


def _bonuses(tier: Column) -> Column:
    return F.filter(tier["property_upgrades"], lambda u: u["name"].isNotNull())


def weapon_tier(properties: Column, upgrades: Column, rules: Rules) -> Column:
    """0 if a base property works through the gun, else the first upgrade (from 1) that adds one, -1 for none."""
    base = F.exists(F.map_entries(properties), lambda e: through_gun(e["key"], e["value"], rules) & is_set(e["value"]))
    adds = lambda u: through_gun(u["name"], F.try_element_at(properties, u["name"]), rules) & (F.coalesce(leading_number(u["bonus"]), F.lit(0.0)) != 0)
    first = F.array_position(F.transform(upgrades, lambda t: F.coalesce(F.exists(_bonuses(t), adds), F.lit(False))), F.lit(True))
    return F.when(F.coalesce(base, F.lit(False)), 0).when(F.coalesce(first, F.lit(0)) > 0, first.cast("int")).otherwise(-1)


def spirit_scaling(properties: Column, rules: Rules) -> Column:
    """Whether any property scales with spirit."""
    marks = lambda p, field, values: F.coalesce(p["scale_function"][field].isin(*values), F.lit(False)) if values else F.lit(False)
    return F.coalesce(F.exists(F.map_values(properties), lambda p: marks(p, "specific_stat_scale_type", rules.scale_types) | marks(p, "class_name", rules.scale_classes)), F.lit(False))


def ability_table(abilities: DataFrame, slots: DataFrame, rules: Rules) -> DataFrame:
    """One row per hero ability (id, hero, name, properties, upgrades) with its slot (hero_id, ability_id, signature_slot;
    0 for none), the marks of the gun (by any name, by listed names, set or granted), the tier that grants it,
    spirit scaling, and the categories that each level opens."""
    p, u = F.col("properties"), F.coalesce(F.col("upgrades"), F.array().cast(abilities.schema["upgrades"].dataType))
    listed = F.coalesce(F.exists(F.map_entries(p), lambda e: through_gun(e["key"], e["value"], rules)), F.lit(False))
    names = F.array_union(F.coalesce(F.map_keys(p), F.array().cast("array<string>")), F.coalesce(F.flatten(F.transform(u, lambda t: F.coalesce(F.transform(_bonuses(t), lambda b: b["name"]), F.array().cast("array<string>")))), F.array().cast("array<string>")))
    broad = F.exists(names, lambda n: ~(n.isin(*rules.ignored) if rules.ignored else F.lit(False)) & n.rlike(f"(?i){rules.broad}"))
    opened = lambda i: F.array_sort(F.array_distinct(F.coalesce(F.transform(_bonuses(F.try_element_at(u, F.lit(i + 1))), lambda b: category(b["name"], F.try_element_at(p, b["name"]), rules)), F.array().cast("array<string>"))))
    known = abilities.where(F.col("hero").isNotNull())
    told = known.select(
        F.col("id").alias("ability_id"), F.col("hero").alias("hero_id"), "name", (F.size(u) > 0).alias("has_upgrades"), F.size(u).alias("n_tiers"), broad.alias("weapon_broad"), listed.alias("weapon_listed"),
        weapon_tier(p, u, rules).alias("weapon_tier"), spirit_scaling(p, rules).alias("spirit_scaling"), *(opened(i).alias(f"cats_l{level}") for i, level in enumerate(LEVELS)),
    ).withColumn("weapon_attached", F.col("weapon_tier") >= 0)
    return told.join(slots, ["hero_id", "ability_id"], "left").withColumn("signature_slot", F.coalesce("signature_slot", F.lit(0)))


def routed_slots(table: DataFrame, flag: str = "weapon_attached") -> DataFrame:
    """(hero_id, slot): signature slots that scale with spirit and work through the gun."""
    return table.where((F.col("signature_slot") > 0) & F.col(flag) & F.col("spirit_scaling")).select("hero_id", F.col("signature_slot").alias("slot")).distinct()


def tier_effects(table: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(hero_id, slot, level, category): what each tier of a signature ability opens."""
    tiers = F.array(*(F.struct(F.lit(level).alias("level"), F.col(f"cats_l{level}").alias("cats")) for level in levels))
    rows = table.where("signature_slot > 0").select("hero_id", F.col("signature_slot").alias("slot"), F.explode(tiers).alias("t"))
    return rows.select("hero_id", "slot", "t.level", F.explode("t.cats").alias("category")).distinct()


def routed_block(shares: DataFrame, exposure: DataFrame, keys: list[str], source: str = "spirit") -> DataFrame:
    """(keys, <source>_via_gun): a player's share of one family times the exposure ``w`` to routed abilities."""
    return shares.join(exposure, keys, "left").select(*keys, (F.col(source) * F.coalesce("w", F.lit(0.0))).alias(f"{source}_via_gun"))
