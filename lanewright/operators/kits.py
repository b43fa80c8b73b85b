"""What heroes' abilities do, by words of their descriptions, and which families of play that points to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.functions.text import stripped
from lanewright.operators import families


def ability_text(description: Column) -> Column:
    """The first of ``desc``, ``active`` and ``passive`` that holds words, without markup; empty if none does."""
    said = [F.when(description[f].rlike(r"\S"), description[f]) for f in ("desc", "active", "passive")]
    return F.coalesce(stripped(F.coalesce(*said)), F.lit(""))


def ability_tags(abilities: DataFrame, patterns: dict[str, str], yields: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(id, tag) of abilities (id, description).  ``yields``: tag -> (other, regex): the tag goes where the other one
    is found too, unless the text matches the regex."""
    texts = abilities.select("id", ability_text(F.col("description")).alias("_text")).where("_text <> ''")
    found = families.tags(texts, "id", "_text", patterns)
    for tag, (other, unless) in (yields or {}).items():
        firm = texts.where(F.col("_text").rlike(f"(?i){unless}")).select("id", F.lit(tag).alias("tag"))
        loose = found.where(F.col("tag") == other).select("id", F.lit(tag).alias("tag")).join(firm, ["id", "tag"], "left_anti")
        found = found.join(loose, ["id", "tag"], "left_anti")
    return found


def hero_kits(tags: DataFrame, slots: DataFrame, heroes: DataFrame) -> DataFrame:
    """(hero_id, tag, n): signature abilities (hero_id, ability_id, signature_slot) of the given heroes (hero_id) with each tag."""
    own = slots.where("signature_slot > 0").join(heroes.select("hero_id"), "hero_id", "left_semi").select("hero_id", F.col("ability_id").alias("id"))
    return own.join(tags, "id").groupBy("hero_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def heroes_by_tag(kits: DataFrame, heroes: DataFrame, tag: str) -> DataFrame:
    """(name, n) of the heroes with a tag, most abilities first, then by name."""
    named = kits.where(F.col("tag") == tag).join(heroes.select("hero_id", "name"), "hero_id", "left")
    return named.select(F.coalesce("name", F.col("hero_id").cast("string")).alias("name"), "n").orderBy(F.desc("n"), "name")


def kit_families(kits: DataFrame, weights: dict[str, tuple[str, int]]) -> DataFrame:
    """(hero_id, family, score): tags by the weight of the family they stand for (tag -> (family, weight))."""
    family = F.coalesce(*(F.when(F.col("tag") == t, F.lit(f)) for t, (f, _) in weights.items()))
    weight = F.coalesce(*(F.when(F.col("tag") == t, F.lit(w)) for t, (_, w) in weights.items()))
    return kits.withColumn("family", family).where("family is not null").groupBy("hero_id", "family").agg(F.sum(weight * F.col("n")).alias("score"))
