"""Dimension tables from asset files (items, heroes, abilities, ranks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "id long, type string, class_name string, name string, item_slot_type string, item_tier int, cost int, imbue string, shopable boolean, disabled boolean, hero long, component_items array<string>"
HERO = "id int, name string, disabled boolean, in_development boolean, items struct<signature1:string,signature2:string,signature3:string,signature4:string>"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEM).option("multiLine", True).json(path)


def upgrades(raw: DataFrame) -> DataFrame:
    """Items; a missing price is 0."""
    return raw.where("type = 'upgrade'").select("id", "class_name", "name", F.col("item_slot_type").alias("slot_type"), F.col("item_tier").alias("tier"), F.coalesce("cost", F.lit(0)).alias("cost"), "imbue")


def shop(raw: DataFrame) -> DataFrame:
    """Upgrades that are on sale."""
    return upgrades(raw.where("shopable and not coalesce(disabled, false)"))


def abilities(raw: DataFrame) -> DataFrame:
    return raw.where("type = 'ability'").select("id", "class_name", "name", F.col("hero").alias("hero_id"))


def heroes(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(HERO).option("multiLine", True).json(path)
    return raw.select("id", "name", F.coalesce("disabled", F.lit(False)).alias("disabled"), F.coalesce("in_development", F.lit(False)).alias("in_development"), "items")


def playable(heroes_: DataFrame) -> DataFrame:
    return heroes_.where("not disabled")


def signatures(heroes_: DataFrame, abilities_: DataFrame) -> DataFrame:
    """(hero_id, signature_slot, ability_id): the four abilities of each hero, by class name."""
    slots = heroes_.select(F.col("id").alias("hero_id"), F.expr("stack(4, 1, items.signature1, 2, items.signature2, 3, items.signature3, 4, items.signature4) as (signature_slot, class_name)"))
    return slots.join(abilities_.select("class_name", F.col("id").alias("ability_id")), "class_name").select("hero_id", "signature_slot", "ability_id")


def components(raw: DataFrame) -> DataFrame:
    """(item_id, parts): ids of the components in their order; items without any are left out."""
    named = raw.select(F.col("id").alias("item_id"), F.posexplode("component_items").alias("pos", "class_name"))
    ids = raw.select("class_name", F.col("id").alias("part"))
    return named.join(ids, "class_name").groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]).alias("parts"))


def ranks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tier int, name string").option("multiLine", True).json(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(hero_id, archetype_id, fixed): accepted names of a JSON file of ``"hero:archetype": name``; keys that begin with ``_`` are notes."""
    told = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "fixed"))
    part = F.split("key", ":")
    return told.where(~F.col("key").startswith("_") & F.col("fixed").isNotNull()).select(part[0].cast("int").alias("hero_id"), part[1].cast("int").alias("archetype_id"), "fixed")
