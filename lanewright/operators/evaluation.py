"""Coverage gates, order agreement and next-item baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.operators.backoff import hit_place
from lanewright.operators.ranking import global_rank
from lanewright.runtime import stored

SEAT = ["match_id", "player_slot"]
#: Share from which an item is a staple, and players a cell needs for a verdict.
STAPLE, CELL = 0.7, 300


def prevalence(bought: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group, item_id, buyers, share): share of players who bought an item at least once."""
    group = group or []
    players = bought.select(*group, *SEAT).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("_all"))
    buyers = bought.select(*group, *SEAT, "item_id").distinct().groupBy(*group, "item_id").agg(F.count(F.lit(1)).alias("buyers"))
    if group:
        joined = buyers.join(players, group)
    else:
        n = players.first()["_all"]
        joined = buyers.withColumn("_all", F.lit(n))
    return joined.select(*group, "item_id", "buyers", (F.col("buyers") / F.col("_all")).alias("share"), F.col("_all").alias("n_players"))


def uptake(bought: DataFrame, group: list[str]) -> DataFrame:
    """Prevalence with the median place of the first purchase (from 1, half to even)."""
    first = bought.groupBy(*group, *SEAT, "item_id").agg(F.min("step").alias("_s"))
    place = first.groupBy(*group, "item_id").agg(F.bround(F.median("_s") + 1).cast("int").alias("median_place"))
    return prevalence(bought, group).join(place, [*group, "item_id"])


def top_items(bought: DataFrame, group: list[str], n: int = 5) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("buyers"), "item_id"))
    return prevalence(bought, group).withColumn("place", place).where(F.col("place") <= n)


def staples(bought: DataFrame, group: list[str], threshold: float = STAPLE, least: int = CELL) -> DataFrame:
    """(group, item_id, share, conclusive): items at or above the threshold; cells too small prove nothing."""
    return prevalence(bought, group).where(F.col("share") >= threshold).select(*group, "item_id", "share", (F.col("n_players") >= least).alias("conclusive"))


def gate(build: DataFrame, staple_items: DataFrame, group: list[str]) -> DataFrame:
    """(group, n_staples, n_missing, passed): a build fails if it lacks a staple of a conclusive cell."""
    mark = build.select(*group, "item_id").distinct().withColumn("_in", F.lit(1))
    told = staple_items.join(mark, [*group, "item_id"], "left").groupBy(*group).agg(F.count(F.lit(1)).alias("n_staples"), F.sum(F.when(F.col("_in").isNull(), 1).otherwise(0)).alias("n_missing"), F.min("conclusive").alias("conclusive"))
    return told.select(*group, "n_staples", "n_missing", (F.col("conclusive") & (F.col("n_missing") == 0)).alias("passed"))


def item_columns(bought: DataFrame, cell: list[str], within: list[str], n: int = 6) -> DataFrame:
    """(cell, kind, place, item_id, gap): of each cell the ``n`` commonest items, and the ``n`` whose
    share most exceeds their share among the other cells of ``within``."""
    inside = prevalence(bought, cell)
    total = inside.groupBy(*within, "item_id").agg(F.sum("buyers").alias("_b"))
    sizes = inside.select(*cell, "n_players").distinct().groupBy(*within).agg(F.sum("n_players").alias("_n"))
    rows = inside.join(total, [*within, "item_id"]).join(sizes, within)
    gap = F.col("share") - F.coalesce(F.try_divide(F.col("_b") - F.col("buyers"), F.col("_n") - F.col("n_players")), F.lit(0.0))
    rows = rows.withColumn("gap", F.round(gap, 9))
    common = F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("buyers"), "item_id"))
    apart = F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("gap"), "item_id"))
    ranked = rows.withColumn("_c", common).withColumn("_a", apart)
    pick = lambda kind, c: ranked.where(F.col(c) <= n).select(*cell, F.lit(kind).alias("kind"), F.col(c).alias("place"), "item_id", "gap")
    return pick("common", "_c").unionByName(pick("apart", "_a"))


def median_order(bought: DataFrame, group: list[str]) -> DataFrame:
    """(group, item_id, median_step): items by the median place at which they are bought."""
    return bought.groupBy(*group, "item_id").agg(F.median("step").alias("median_step"))


def order_agreement(first: DataFrame, second: DataFrame, group: list[str]) -> DataFrame:
    """(group, n_shared, tau, jaccard_6, jaccard_12) of two orders (group, item_id, place).

    Pairs are formed within a group's shared items, which the shop bounds."""
    both = first.select(*group, "item_id", F.col("place").alias("a")).join(second.select(*group, "item_id", F.col("place").alias("b")), [*group, "item_id"])
    other = both.select(*group, F.col("item_id").alias("_other"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    pairs = both.join(other, group).where(F.col("a") < F.col("_a"))
    tau = pairs.groupBy(*group).agg((F.sum(F.signum((F.col("_b") - F.col("b")).cast("double"))) / F.count(F.lit(1))).alias("tau"))
    shared = both.groupBy(*group).agg(F.count(F.lit(1)).alias("n_shared"))

    def overlap(k: int) -> DataFrame:
        x = first.where(F.col("place") <= k).select(*group, "item_id").withColumn("_x", F.lit(1))
        y = second.where(F.col("place") <= k).select(*group, "item_id").withColumn("_y", F.lit(1))
        return x.join(y, [*group, "item_id"], "full").groupBy(*group).agg((F.sum(F.when(F.col("_x").isNotNull() & F.col("_y").isNotNull(), 1).otherwise(0)) / F.count(F.lit(1))).alias(f"jaccard_{k}"))

    return shared.join(tau, group, "left").join(overlap(6), group, "left").join(overlap(12), group, "left")


def jaccard(a: Column, b: Column) -> Column:
    """Shared items over all items of two arrays; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def membership(build: DataFrame, bought: DataFrame, group: list[str], k: int = 12) -> DataFrame:
    """(group, n_players, jaccard, ceiling, ratio): mean overlap of a build's first ``k`` items with those of every
    player who bought at least ``k``, and of players with each other.

    All players count.  For the ceiling each is compared with the next one in a shuffled ring, so its cost
    grows with the players and not with their pairs; it is null below two players."""
    first = bought.where(F.col("step") < k).groupBy(*group, *SEAT).agg(F.collect_set("item_id").alias("own"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k)
    key = F.md5(F.concat_ws("/", *(F.col(c).cast("string") for c in SEAT)))
    ring = stored(global_rank(first.drop("_n").withColumn("_key", key), group, ["_key", *SEAT]), "ring")
    after = ring.select(*group, F.when(F.col("rank") == 1, F.col("rank_n")).otherwise(F.col("rank") - 1).alias("rank"), F.col("own").alias("other"))
    mark = build.where(F.col("place") <= k).groupBy(*group).agg(F.collect_set("item_id").alias("build"))
    rows = ring.join(after, [*group, "rank"]).join(mark, group)
    told = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_players"), F.avg(jaccard(F.col("build"), F.col("own"))).alias("jaccard"), F.avg(F.when(F.col("rank_n") > 1, jaccard(F.col("own"), F.col("other")))).alias("ceiling"))
    return told.withColumn("ratio", F.try_divide("jaccard", "ceiling"))


def ranked_lists(train: DataFrame, context: list[str]) -> DataFrame:
    """(context, item_id, n, place): what follows a context, commonest first, ties to the smaller id."""
    counts = train.groupBy(*context, "item_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*context).orderBy(F.desc("n"), "item_id")))


def popularity_lists(train: DataFrame) -> DataFrame:
    """As ``ranked_lists`` by hero, but over players rather than purchases."""
    return ranked_lists(train.select("hero_id", *SEAT, "item_id").distinct(), ["hero_id"])


def hit_places(decisions: DataFrame, lists: DataFrame, context: list[str]) -> DataFrame:
    """``decisions`` (context, item_id, owned) with ``hit``: the place of the bought item in its context's list
    once the items already owned are taken out; null if it is owned already or not listed.

    A context's list is one array, bounded by the shop; it meets its decisions in one join."""
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("place", "item_id"))), lambda x: x["item_id"])
    return decisions.join(lists.groupBy(*context).agg(ranked.alias("_list")), context, "left").withColumn("hit", hit_place(F.col("_list"), F.col("owned"), F.col("item_id"))).drop("_list")


def accuracy(hits: DataFrame, group: list[str] | None = None, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """(group, n, top_k...): share of decisions whose item is among the first k; no list is a miss."""
    return hits.groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.coalesce((F.col("hit") <= k).cast("double"), F.lit(0.0))).alias(f"top_{k}") for k in ks))
