"""Items, abilities and players by family of play."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Margins below which a name is withheld, or joined with the runner-up.
NAME_MARGIN, HYBRID_MARGIN = 1.3, 1.7


def text_evidence(texts: DataFrame, key: str, text: str, patterns: dict[str, tuple[str, int]]) -> DataFrame:
    """(key, family, score): weight of each pattern (family -> (regex, weight)) that a text matches, any case."""
    hits = F.array_compact(F.array(*(F.when(F.col(text).rlike(f"(?i){regex}"), F.struct(F.lit(f).alias("family"), F.lit(w).alias("score"))) for f, (regex, w) in patterns.items())))
    return texts.select(key, F.explode(hits).alias("h")).select(key, "h.family", "h.score")


def raw_stats(items: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(item_id, stat, value) of raw items (id, properties map<string,struct<value>>, upgrades array<struct<property_upgrades:
    array<struct<name,bonus>>>>): every property and every bonus of an upgrade, but for the ``ignored`` names."""
    of = F.transform(F.map_entries("properties"), lambda e: F.struct(e["key"].alias("stat"), e["value"]["value"].alias("value")))
    more = F.flatten(F.transform("upgrades", lambda u: F.transform(u["property_upgrades"], lambda b: F.struct(b["name"].alias("stat"), b["bonus"].alias("value")))))
    none = F.array().cast("array<struct<stat:string,value:string>>")
    rows = items.select(F.col("id").alias("item_id"), F.explode(F.concat(F.coalesce(of, none), F.coalesce(more, none))).alias("s")).select("item_id", "s.*")
    return rows.where(F.col("stat").isNotNull() & (~F.col("stat").isin(*ignored) if ignored else F.lit(True)))


def stat_evidence(stats: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, family, score) from non-zero stats (key, stat, value) and a small table (stat, family, score)."""
    number = F.expr("try_cast(value as double)")
    counted = stats.where(F.when(number.isNotNull(), number != 0).otherwise(F.length("value") > 0)).select(key, "stat").distinct()
    return counted.join(F.broadcast(weights), "stat").select(key, "family", "score")


def family_scores(*evidence: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, family, score): all evidence added up."""
    rows = evidence[0]
    for other in evidence[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy(key, "family").agg(F.sum("score").alias("score"))


def rarity(scores: DataFrame, n_all: int, key: str = "item_id", of: str = "family") -> DataFrame:
    """(of, idf): ln of all keys over the keys that have it."""
    return scores.select(key, of).distinct().groupBy(of).agg(F.ln(F.lit(float(n_all)) / F.count(F.lit(1))).alias("idf"))


def family_weights(scores: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, family, w): scores as shares of the item."""
    return scores.select(key, "family", (F.col("score") / F.sum("score").over(Window.partitionBy(key))).alias("w"))


def family_shares(bought: DataFrame, shop: DataFrame, weights: DataFrame, families: list[str], keys: list[str]) -> DataFrame:
    """One column a family: share of the player's spending on it; players without any are dropped.

    The family weights are a few rows per shop item."""
    priced = bought.join(F.broadcast(shop.select(F.col("id").alias("item_id"), F.coalesce("cost", F.lit(0)).alias("cost"))), "item_id")
    spent = priced.join(F.broadcast(weights), "item_id").withColumn("_s", F.col("cost") * F.col("w"))
    wide = spent.groupBy(*keys).agg(F.sum("_s").alias("_all"), *(F.sum(F.when(F.col("family") == f, F.col("_s")).otherwise(0.0)).alias(f) for f in families))
    return wide.where(F.col("_all") > 0).select(*keys, *((F.col(f) / F.col("_all")).alias(f) for f in families))


def slot_shares(bought: DataFrame, shop: DataFrame, slots: list[str], keys: list[str]) -> DataFrame:
    """One column a shop tab: its share of the player's spending; 0 where nothing was spent."""
    priced = bought.join(F.broadcast(shop.where("slot_type is not null").select(F.col("id").alias("item_id"), "slot_type", F.coalesce("cost", F.lit(0)).alias("cost"))), "item_id")
    wide = priced.groupBy(*keys).agg(F.sum("cost").alias("_all"), *(F.sum(F.when(F.col("slot_type") == s, F.col("cost")).otherwise(0)).alias(s) for s in slots))
    return wide.select(*keys, *(F.coalesce(F.try_divide(F.col(s), F.col("_all")), F.lit(0.0)).alias(s) for s in slots))


def scored_families(lifts: DataFrame, scores: DataFrame, idf: DataFrame, group: list[str]) -> DataFrame:
    """(group, family, score): positive lifts of items times their family scores times the family's rarity."""
    rows = lifts.join(F.broadcast(scores), "item_id").join(F.broadcast(idf), "family")
    return rows.groupBy(*group, "family").agg(F.sum(F.greatest(F.col("lift"), F.lit(0.0)) * F.col("score") * F.col("idf")).alias("score"))


def names(scores: DataFrame, group: list[str], title: str, margin: float = NAME_MARGIN, hybrid: float = HYBRID_MARGIN) -> DataFrame:
    """(group, name, margin): the leading family, with the runner-up if close, before the title; the title alone if unclear."""
    w = Window.partitionBy(*group).orderBy(F.desc(F.round("score", 9)), F.desc("family"))
    two = scores.withColumn("_p", F.row_number().over(w)).groupBy(*group).agg(*(F.max(F.when(F.col("_p") == p, F.col(c))).alias(f"{c}_{p}") for p in (1, 2) for c in ("family", "score")))
    ratio = F.when(F.coalesce("score_2", F.lit(0.0)) > 0, F.col("score_1") / F.col("score_2")).otherwise(F.lit(float("inf")))
    rows = two.withColumn("margin", ratio)
    name = F.when((F.col("score_1") <= 0) | (F.col("margin") < margin), F.col(title) if title in group else F.lit(title))
    joined = F.when(F.col("margin") < hybrid, F.concat_ws("-", "family_1", "family_2")).otherwise(F.col("family_1"))
    return rows.select(*group, F.coalesce(name.cast("string"), F.concat_ws(" ", joined, (F.col(title) if title in group else F.lit(title)).cast("string"))).alias("name"), "margin")


def tags(texts: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, tag): every tag whose pattern the text matches, any case."""
    hits = F.array_compact(F.array(*(F.when(F.col(text).rlike(f"(?i){regex}"), F.lit(t)) for t, regex in patterns.items())))
    return texts.select(key, F.explode(hits).alias("tag"))


def first_category(name: str, patterns: dict[str, str], otherwise: str = "other"):
    """Column: the first category whose pattern ``name`` matches."""
    out = None
    for category, regex in patterns.items():
        test = F.col(name).rlike(f"(?i){regex}")
        out = F.when(test, category) if out is None else out.when(test, category)
    return out.otherwise(otherwise)
