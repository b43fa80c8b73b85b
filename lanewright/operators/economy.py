"""Spending of each player over a match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a gap above this multiple of the player's own median gap counts as saving up.
SAVING = 1.5


def with_costs(bought: DataFrame, shop: DataFrame) -> DataFrame:
    """``cost`` and ``tier`` of each purchase; unknown items have neither.  The shop is a few hundred rows."""
    return bought.join(F.broadcast(shop.select(F.col("id").alias("item_id"), "cost", "tier")), "item_id", "left")


def economics(bought: DataFrame, shop: DataFrame, keys: list[str]) -> DataFrame:
    """Ten measures a player: cost sum, mean, maximum and slope over the place in the order,
    tier mean, maximum and number of rises, median gap, and number and share of gaps spent saving.

    One exchange on the player: both windows and the aggregate share its partitioning.
    """
    order = Window.partitionBy(*keys).orderBy("step")
    rows = with_costs(bought, shop).withColumn("gap", F.col("buy_time_s") - F.lag("buy_time_s").over(order)).withColumn("rise", F.col("tier") - F.lag("tier").over(order))
    rows = rows.withColumn("own", F.median("gap").over(Window.partitionBy(*keys)))
    saved = F.sum(F.when(F.col("gap") > SAVING * F.col("own"), 1).otherwise(0))
    return rows.groupBy(*keys).agg(
        F.coalesce(F.sum("cost"), F.lit(0)).alias("cost_sum"),
        F.avg("cost").alias("cost_mean"),
        F.max("cost").alias("cost_max"),
        F.coalesce(F.regr_slope(F.col("cost").cast("double"), F.col("step").cast("double")), F.lit(0.0)).alias("cost_slope"),
        F.avg("tier").alias("tier_mean"),
        F.max("tier").alias("tier_max"),
        F.sum(F.when(F.col("rise") > 0, 1).otherwise(0)).alias("tier_rises"),
        F.coalesce(F.max("own"), F.lit(0.0)).alias("median_gap"),
        saved.alias("saved_up"),
        F.coalesce(F.try_divide(saved, F.count("gap")), F.lit(0.0)).alias("saved_up_share"),
    )


def visits(bought: DataFrame, keys: list[str], gap_s: float = 5.0) -> DataFrame:
    """(keys, visit, n, from_s, to_s): purchases at most ``gap_s`` apart are one visit to the shop."""
    order = Window.partitionBy(*keys).orderBy("step")
    new = F.when(F.col("buy_time_s") - F.lag("buy_time_s").over(order) <= gap_s, 0).otherwise(1)
    return bought.withColumn("_new", new).withColumn("visit", F.sum("_new").over(order)).groupBy(*keys, "visit").agg(F.count(F.lit(1)).alias("n"), F.min("buy_time_s").alias("from_s"), F.max("buy_time_s").alias("to_s"))
