"""Percentiles from counts in signed logarithmic buckets.

A value x falls into bucket ``sign(x) * (ceil(ln|x| / ln g) + OFFSET)`` with
``g = (1 + a) / (1 - a)``; zero has bucket 0.  The middle ``2 g^k / (g + 1)``
of a bucket differs from every value in it by at most the share ``a``.  Bucket
counts of separate loads are added, so sketches merge without loss, in any
order, and a percentile of the merged sketch keeps the same bound.

Defined results: null and NaN values do not count; infinities fall into the
outermost buckets and come out as infinities; a group without values has no
row; null is a group key like any other; an empty table gives an empty sketch.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.llm.purchases import distinct_purchases
from lanewright.runtime import stored

#: Added to a bucket's exponent so that small values keep their sign: covers all doubles for a >= 1e-5.
OFFSET = 80_000_000


def bucket_of(value: Column, accuracy: float) -> Column:
    """Signed bucket number of ``value``."""
    log_base = math.log((1 + accuracy) / (1 - accuracy))
    size = F.abs(value)
    inner = F.when(size == float("inf"), F.lit(OFFSET)).otherwise(F.ceil(F.ln(size) / log_base).cast("long"))
    return F.when(value == 0, F.lit(0).cast("long")).otherwise(F.signum(value).cast("long") * (inner + OFFSET))


def bucket_value(bucket: Column, accuracy: float) -> Column:
    """The value that stands for a bucket, within the share ``accuracy`` of all its members."""
    base = (1 + accuracy) / (1 - accuracy)
    power = F.abs(bucket) - OFFSET
    size = F.when(power == OFFSET, float("inf")).otherwise(F.exp(power * math.log(base)) * (2 / (base + 1)))
    return F.when(bucket == 0, 0.0).otherwise(F.signum(bucket.cast("double")) * size)


def sketch(rows: DataFrame, keys: list[str], value: str, accuracy: float = 0.01) -> DataFrame:
    """(keys, bucket, n): the counts are combined on the map side, so what is
    shuffled is bounded by groups times buckets, whatever a group's size."""
    return rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, bucket_of(F.col(value).cast("double"), accuracy).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The sketch of all loads together."""
    keys = [c for c in first.columns if c != "n"]
    for other in others:
        first = first.unionByName(other)
    return first.groupBy(*keys).agg(F.sum("n").alias("n"))


def ranks(buckets: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, bucket, n_group, before): of each group the bucket that holds the
    smallest value which at least ``share`` of the values do not exceed, and the
    number of values below that bucket."""
    group = Window.partitionBy(*keys)
    upto = F.sum("n").over(group.orderBy("bucket"))
    return (
        buckets.select(*keys, "bucket", "n", F.sum("n").over(group).alias("n_group"), (upto - F.col("n")).alias("before"))
        .where((F.col("before") < F.greatest(F.lit(1), F.ceil(F.col("n_group") * share))) & (F.col("before") + F.col("n") >= F.greatest(F.lit(1), F.ceil(F.col("n_group") * share))))
        .drop("n")
    )


def percentiles(buckets: DataFrame, keys: list[str], shares: list[float], accuracy: float = 0.01) -> DataFrame:
    """(keys, share, n_group, value), each value within the share ``accuracy`` of the exact one."""
    group = Window.partitionBy(*keys)
    upto = F.sum("n").over(group.orderBy("bucket"))
    need = F.greatest(F.lit(1), F.ceil(F.col("n_group") * F.col("share")))
    return (
        buckets.select(*keys, "bucket", "n", F.sum("n").over(group).alias("n_group"), (upto - F.col("n")).alias("before"))
        .withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares))))
        .where((F.col("before") < need) & (F.col("before") + F.col("n") >= need))
        .select(*keys, "share", "n_group", bucket_value(F.col("bucket"), accuracy).alias("value"))
    )


def bucket_bounds(bucket: Column, accuracy: float) -> tuple[Column, Column]:
    """Values between which all members of a bucket lie (a hair wider, for rounding)."""
    log_base = math.log((1 + accuracy) / (1 - accuracy))
    power = F.abs(bucket) - OFFSET
    inner = lambda step, hair: F.when(power == OFFSET, float("inf")).otherwise(F.exp((power + step) * log_base) * (1 + hair))
    small, large = inner(-1, -1e-9), inner(0, 1e-9)
    low = F.when(bucket == 0, 0.0).when(bucket > 0, small).otherwise(-large)
    return low, F.when(bucket == 0, 0.0).when(bucket > 0, large).otherwise(-small)


def exact_medians(rows: DataFrame, keys: list[str], value: str, wanted: DataFrame, accuracy: float = 0.01) -> DataFrame:
    """(keys, median): exact medians of the groups in ``wanted`` (rows of ``ranks``).

    Only values inside a group's median bucket are looked at, counted by value
    first, so equal values of a hot group travel as one row.  ``rows`` must be
    those that the buckets were counted from, without repeats.
    """
    mark = bucket_of(F.col(value).cast("double"), accuracy)
    side = wanted.select(*(F.col(k).alias(f"w_{k}") for k in keys), F.col("bucket").alias("w_bucket"), "n_group", "before")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in keys)) & (F.col("bucket") == F.col("w_bucket"))
    inside = rows.withColumn("bucket", mark).join(side.drop("n_group", "before"), same, "left_semi")
    counted = inside.groupBy(*keys, "bucket", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.join(side, same)
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("v")) + F.col("before")
    return ranked.select(*keys, "v", "n_group", upto.alias("upto")).where(F.col("upto") * 2 >= F.col("n_group")).groupBy(*keys).agg(F.min("v").alias("median"))


def bounded_medians(by_group: DataFrame, factor: float, at_least: int, accuracy: float) -> DataFrame:
    """(hero_id, item_id, settled, ranks of the group and of the item): groups of ``at_least`` purchases whose
    median may be ``factor`` times the item's; ``settled`` if the sketches' bounds alone prove that it is."""
    of_item = ranks(by_group.groupBy("item_id", "bucket").agg(F.sum("n").alias("n")), ["item_id"], 0.5)
    of_item = of_item.select("item_id", *(F.col(c).alias(f"item_{c}") for c in ("bucket", "n_group", "before")))
    of_group = ranks(by_group.where(F.col("hero_id").isNotNull()), ["hero_id", "item_id"], 0.5).where(F.col("n_group") >= at_least)
    low, high = bucket_bounds(F.col("bucket"), accuracy)
    item_low, item_high = (F.lit(factor) * x for x in bucket_bounds(F.col("item_bucket"), accuracy))
    return of_group.join(of_item, "item_id").where(high >= item_low).withColumn("settled", low >= item_high)


def slow_groups(purchases: DataFrame, factor: float = 2.0, at_least: int = 10, accuracy: float = 0.01) -> DataFrame:
    """(hero_id, item_id) whose median buy time is at least ``factor`` times the
    item's median, over groups of ``at_least`` purchases.

    The sketches bound both medians, which settles most groups either way; only
    the groups whose bounds overlap (and their items) get exact medians.
    Purchases without hero count towards the item and form no group of their own.
    """
    sound = purchases.where(F.col("item_id").isNotNull() & F.col("buy_time_s").isNotNull() & ~F.isnan("buy_time_s"))
    # repeats go before the buckets are picked: a repeat may differ in time
    once = stored(distinct_purchases(sound, ["hero_id", "item_id", "buy_time_s"]).drop("match_id", "player_slot", "buy_index"), "once")
    by_group = stored(sketch(once, ["hero_id", "item_id"], "buy_time_s", accuracy), "sketch")
    maybe = stored(bounded_medians(by_group, factor, at_least, accuracy), "medians")
    sure, open_ = maybe.where("settled").select("hero_id", "item_id"), maybe.where("not settled")
    if open_.isEmpty():
        return sure
    groups = exact_medians(once, ["hero_id", "item_id"], "buy_time_s", open_.select("hero_id", "item_id", "bucket", "n_group", "before"), accuracy)
    items = open_.select("item_id", F.col("item_bucket").alias("bucket"), F.col("item_n_group").alias("n_group"), F.col("item_before").alias("before")).distinct()
    of_items = exact_medians(once, ["item_id"], "buy_time_s", items, accuracy).withColumnRenamed("median", "item_median")
    return sure.unionByName(groups.join(of_items, "item_id").where(F.col("median") >= factor * F.col("item_median")).select("hero_id", "item_id"))
