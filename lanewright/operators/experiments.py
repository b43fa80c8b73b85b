"""Measures that compare groupings and decide between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.functions.stats import correlation
from lanewright.operators import backoff, evaluation
from lanewright.runtime import stored


def adjusted_rand(labels: DataFrame, first: str, second: str, group: list[str] | None = None) -> DataFrame:
    """(group, n, ari) of two labelings of the same rows, from their contingency table."""
    group = group or []
    pairs = lambda c: c * (c - 1) / 2
    cells = labels.groupBy(*group, first, second).agg(F.count(F.lit(1)).cast("double").alias("c"))
    both = cells.groupBy(*group).agg(F.sum(pairs(F.col("c"))).alias("ij"), F.sum("c").alias("n"))
    side = lambda x, name: cells.groupBy(*group, x).agg(F.sum("c").alias("c")).groupBy(*group).agg(F.sum(pairs(F.col("c"))).alias(name))
    a, b = side(first, "a"), side(second, "b")
    if group:
        rows = both.join(a, group).join(b, group)
    else:
        one = lambda d: d.withColumn("_k", F.lit(1))
        rows = one(both).join(one(a), "_k").join(one(b), "_k").drop("_k")
    expected = F.coalesce(F.try_divide(F.col("a") * F.col("b"), pairs(F.col("n"))), F.lit(0.0))
    return rows.select(*group, F.col("n").cast("long").alias("n"), F.coalesce(F.try_divide(F.col("ij") - expected, (F.col("a") + F.col("b")) / 2 - expected), F.lit(1.0)).alias("ari"))


def concentration(rows: DataFrame, item: str = "item_id") -> DataFrame:
    """(n, top_share, top_3_share): how much of a list of items falls on its commonest one and three."""
    counts = rows.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), item).limit(3).agg(F.max("n").alias("one"), F.sum("n").alias("three")).withColumn("_k", F.lit(1))
    total = counts.agg(F.sum("n").alias("n")).withColumn("_k", F.lit(1))
    return total.join(top, "_k").select("n", (F.col("one") / F.col("n")).alias("top_share"), (F.col("three") / F.col("n")).alias("top_3_share"))


def share_distance(first: DataFrame, second: DataFrame, columns: dict[str, str], keys: list[str]) -> DataFrame:
    """(keys, distance): half the sum of absolute differences between two tables of shares
    (columns: name in the first -> name in the second)."""
    right = second.select(*keys, *(F.col(b).alias(f"_{a}") for a, b in columns.items()))
    total: Column = F.lit(0.0)
    for a in columns:
        total = total + F.abs(F.col(a) - F.col(f"_{a}"))
    return first.join(right, keys).select(*keys, (total / 2).alias("distance"))


def permutation_test(rows: DataFrame, value: str, flag: str, key: str, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """(n, difference, p): difference of the flagged and unflagged means, and the share of
    shuffled flags with one as large, two-sided, (hits + 1) / (draws + 1).

    Every draw ranks the rows by a hash of draw and key and flags the first of
    them, so draws are spread over the cluster; meant for small tables of groups.
    """
    known = rows.where(F.col(value).isNotNull() & F.col(flag).isNotNull()).select(F.col(value).cast("double").alias("v"), F.col(flag).cast("boolean").alias("f"), F.col(key).alias("k"))
    seen = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("f").cast("int")).alias("k"), (F.avg(F.when(F.col("f"), F.col("v"))) - F.avg(F.when(~F.col("f"), F.col("v")))).alias("d")).first()
    spark = rows.sparkSession
    if seen["d"] is None:
        return spark.createDataFrame([(seen["n"], None, None)], "n long, difference double, p double")
    drawn = known.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    rank = F.row_number().over(Window.partitionBy("draw").orderBy(F.xxhash64(F.lit(seed), "draw", "k"), "k"))
    flagged = drawn.withColumn("g", rank <= seen["k"])
    diffs = flagged.groupBy("draw").agg((F.avg(F.when(F.col("g"), F.col("v"))) - F.avg(F.when(~F.col("g"), F.col("v")))).alias("d"))
    hits = F.sum((F.abs("d") >= abs(seen["d"]) - 1e-12).cast("int"))
    return diffs.agg(F.lit(seen["n"]).cast("long").alias("n"), F.lit(float(seen["d"])).alias("difference"), ((hits + 1) / (draws + 1)).alias("p"))


def spearman(rows: DataFrame, first: str, second: str) -> DataFrame:
    """(n, rho): correlation of mean ranks.  Ranks come from counts by value."""
    known = rows.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(first, second)

    def ranks(c: str) -> DataFrame:
        counts = known.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        w = Window.orderBy(c)  # one row per distinct value
        return counts.select(c, (F.sum("_n").over(w) - (F.col("_n") - 1) / 2).alias(f"_r_{c}"))

    return known.join(ranks(first), first).join(ranks(second), second).agg(F.count(F.lit(1)).alias("n"), correlation(f"_r_{first}", f"_r_{second}").alias("rho"))


def standard_error(share: Column, n: Column) -> Column:
    return F.sqrt(share * (1 - share) / n)


def aim_and_purchase(labels: DataFrame, rows: DataFrame, bought: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """(hero_id, item_id, aim_gap, rate_gap): between a hero's clusters, the largest gap of the target
    shares of an item (clusters with ``least`` buyers) and of its purchase rates."""
    sizes = labels.groupBy("hero_id", "archetype_id").agg(F.count(F.lit(1)).alias("_all"))
    own = bought.select(*keys, "item_id").distinct().join(labels, keys).groupBy("hero_id", "archetype_id", "item_id").agg(F.count(F.lit(1)).alias("_b")).join(sizes, ["hero_id", "archetype_id"])
    rate = own.groupBy("hero_id", "item_id").agg((F.max(F.col("_b") / F.col("_all")) - F.min(F.col("_b") / F.col("_all"))).alias("rate_gap"))
    aimed = rows.join(labels.select(*keys, "archetype_id"), keys).groupBy("hero_id", "archetype_id", "item_id", "signature_slot").agg(F.count(F.lit(1)).alias("n"))
    total = aimed.groupBy("hero_id", "archetype_id", "item_id").agg(F.sum("n").alias("_t")).where(F.col("_t") >= least)
    grid = total.withColumn("signature_slot", F.explode(F.array(*(F.lit(s) for s in (1, 2, 3, 4))))).join(aimed, ["hero_id", "archetype_id", "item_id", "signature_slot"], "left")
    share = grid.select("hero_id", "item_id", "signature_slot", (F.coalesce("n", F.lit(0)) / F.col("_t")).alias("s"))
    aim = share.groupBy("hero_id", "item_id", "signature_slot").agg((F.max("s") - F.min("s")).alias("g")).groupBy("hero_id", "item_id").agg(F.max("g").alias("aim_gap"))
    return aim.join(rate, ["hero_id", "item_id"])


def feature_matrix(shares: DataFrame, block: DataFrame | None, keys: list[str]) -> DataFrame:
    """The players' family shares beside another block of features; a player whom the block lacks has zeros there."""
    if block is None:
        return shares
    extra = [c for c in block.columns if c not in keys]
    return shares.join(block.select(*keys, *extra), keys, "left").fillna(0.0, extra)


def scored_fits(bought: DataFrame, labels: dict[str, DataFrame], train: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """(fit, n, top_1, top_3): how well the next-item model does with each labelling of the players, on the same held-out
    decisions; ``train``: (key, is_train), keys that it lacks train."""
    out = None
    for name, own in labels.items():
        rows = stored(backoff.before_each(bought, own, keys).join(train, key, "left").withColumn("is_train", F.coalesce("is_train", F.lit(True))), "decisions")
        test = rows.where("not is_train")
        levels = stored(backoff.levels(rows.where("is_train")), "levels")
        told = backoff.ranked(test.select(*backoff.KEYS, "owned", "item_id"), backoff.state_tables(test, levels))
        place = F.array_position(F.transform("best", lambda b: b["item_id"]), F.col("item_id")).cast("int")
        score = evaluation.accuracy(told.select(F.nullif(place, F.lit(0)).alias("hit"))).select(F.lit(name).alias("fit"), "n", "top_1", "top_3")
        out = score if out is None else out.unionByName(score)
    return out
