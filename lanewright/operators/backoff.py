"""Next-item model: smoothed counts over six contexts of falling detail.

``levels`` holds (level, ctx, item_id, w, n), ``ctx`` being the level's key
columns joined by ``|``.  With W the weight of a context, a level's share of
the mixture is W / (W + kappa); an unseen context has none.  Hence the chance
of an item is the sum over levels of its local share times the level's part
times what the levels above left over.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.operators.cleaning import time_bucket
from lanewright.runtime import stored

#: Smoothing, target rank and half width, sentinel for "no item".
KAPPA, TARGET, HALF_WIDTH, NO_ITEM = 20.0, 80.0, 25.0, -1
#: Key columns of each level, finest first.
LEVELS = (
    ("hero_id", "archetype_id", "prev_two", "prev_one", "time_bucket"),
    ("hero_id", "archetype_id", "prev_one", "time_bucket"),
    ("hero_id", "archetype_id", "n_owned", "time_bucket"),
    ("hero_id", "archetype_id", "n_owned"),
    ("hero_id", "n_owned"),
    ("hero_id",),
)
KEYS = ("hero_id", "archetype_id", "prev_two", "prev_one", "n_owned", "time_bucket")


def row_weights(df: DataFrame, keys: list[str], target: float | None = None, half_width: float = HALF_WIDTH, win_weight: float = 1.0, familiarity: float = 0.0) -> DataFrame:
    """``df`` with ``weight``, of mean 1: nearness to a target rank (null rank: 1), times
    ``win_weight`` for wins, times 1 + f ln(games) of the account on the hero."""
    w: Column = F.lit(1.0)
    if target is not None:
        w = F.coalesce(F.exp(-F.pow((F.col("average_badge") - target) / half_width, 2)), F.lit(1.0))
    if win_weight != 1.0:
        w = w * F.when(F.col("won"), win_weight).otherwise(1.0)
    if familiarity:
        games = df.groupBy("account_id", "hero_id").agg(F.countDistinct("match_id").alias("_games"))
        df = df.join(games, ["account_id", "hero_id"], "left")
        w = w * (1 + familiarity * F.log1p(F.coalesce(F.col("_games"), F.lit(1)) - 1))
    rows = df.withColumn("_w", w)
    mean = rows.agg(F.avg("_w")).first()[0] or 1.0
    return rows.withColumn("weight", F.col("_w") / F.lit(float(mean))).drop("_w", "_games")


def prepared(bought: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Each purchase with the two before it, the number before it, its time bucket and archetype (0 if unknown)."""
    order = Window.partitionBy(*keys).orderBy("step")
    rows = bought.withColumn("prev_one", F.lag("item_id", 1, NO_ITEM).over(order)).withColumn("prev_two", F.lag("item_id", 2, NO_ITEM).over(order))
    rows = rows.withColumn("n_owned", F.col("step").cast("int")).withColumn("time_bucket", time_bucket(F.col("buy_time_s")))
    return rows.join(labels, keys, "left").fillna(0, ["archetype_id"])


def context(level: int) -> Column:
    return F.concat_ws("|", *(F.col(c).cast("string") for c in LEVELS[level]))


def levels(rows: DataFrame, weight: str | None = None, which: tuple[int, ...] = tuple(range(len(LEVELS)))) -> DataFrame:
    """(level, ctx, item_id, w, n).  Rows are first added up by all key columns, so that
    what is expanded into the levels is the number of distinct contexts, not of rows."""
    w = F.sum(weight) if weight else F.count(F.lit(1)).cast("double")
    fine = rows.groupBy(*KEYS, "item_id").agg(w.alias("w"), F.count(F.lit(1)).alias("n"))
    spread = fine.select("item_id", "w", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), context(k).alias("ctx")) for k in which))).alias("c"))
    return spread.groupBy(F.col("c.level").alias("level"), F.col("c.ctx").alias("ctx"), "item_id").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))


def archetype_shares(bought: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(hero_id, archetype_id, share) over distinct players."""
    players = bought.select("hero_id", *keys).distinct().join(labels, keys, "left").fillna(0, ["archetype_id"])
    counts = players.groupBy("hero_id", "archetype_id").agg(F.count(F.lit(1)).alias("_n"))
    return counts.select("hero_id", "archetype_id", (F.col("_n") / F.sum("_n").over(Window.partitionBy("hero_id"))).alias("share"))


def context_totals(level_table: DataFrame) -> DataFrame:
    """(level, ctx, total): the weight of each context."""
    return level_table.groupBy("level", "ctx").agg(F.sum("w").alias("total"))


def _mixing(states: DataFrame, level_table: DataFrame, kappa: float, totals: DataFrame | None, few: bool, which: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """The contexts of each state that were seen, and (state_id, archetype_id, l<k>...): the mixture share of each level."""
    small = F.broadcast if few else (lambda df: df)
    asked = states.select("state_id", "archetype_id", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), context(k).alias("ctx")) for k in which))).alias("c")).select("state_id", "archetype_id", "c.level", "c.ctx")
    seen = small(asked).join(context_totals(level_table) if totals is None else totals, ["level", "ctx"])
    lam = [F.coalesce(F.max(F.when(F.col("level") == k, F.col("total") / (F.col("total") + kappa))), F.lit(0.0)).alias(f"l{k}") for k in which]
    return seen, seen.groupBy("state_id", "archetype_id").agg(*lam)


def contributions(
    states: DataFrame, level_table: DataFrame, kappa: float = KAPPA, totals: DataFrame | None = None, few: bool = False, which: tuple[int, ...] = tuple(range(len(LEVELS)))
) -> DataFrame:
    """(state_id, archetype_id, item_id, level, part, n): what each level adds to an item's chance.

    ``states``: state_id and the key columns; one row per state and archetype.
    ``totals``: ``context_totals``, for callers that ask often; ``few``: the
    caller has counted the states and found them few enough to broadcast.
    """
    small = F.broadcast if few else (lambda df: df)
    seen, wide = _mixing(states, level_table, kappa, totals, few, which)
    left: Column = F.lit(1.0)
    parts = []
    for k in which:
        parts.append(F.when(F.col("level") == k, left * F.col(f"l{k}")))
        left = left * (1 - F.col(f"l{k}"))
    share = seen.join(small(wide), ["state_id", "archetype_id"]).select("state_id", "archetype_id", "level", "ctx", (F.coalesce(*parts) / F.col("total")).alias("scale"))
    return small(share).join(level_table, ["level", "ctx"]).select("state_id", "archetype_id", "item_id", "level", (F.col("scale") * F.col("w")).alias("part"), "n")


def distribution(states: DataFrame, level_table: DataFrame, owned: DataFrame, kappa: float = KAPPA, mixture: bool = False) -> DataFrame:
    """(state_id, item_id, p): chances mixed over archetypes (by ``states.share`` if
    ``mixture``), then without owned items (state_id, item_id), then made to sum to 1.

    The levels that do not look at the last items are mixed once per distinct
    coarse context, not once per state; a state adds its two fine levels and
    what they leave over times the coarse mixture.  All rows of a state then
    meet in one exchange, which the sum, the mask and the ranking share.
    """
    fine, coarse = (0, 1), tuple(range(2, len(LEVELS)))
    keys = ["hero_id", "archetype_id", "n_owned", "time_bucket"]
    coarse_id = F.concat_ws("|", *(F.col(c).cast("string") for c in keys))
    base = contributions(states.select(*keys).distinct().withColumn("state_id", coarse_id), level_table, kappa, which=coarse)
    base = base.groupBy(F.col("state_id").alias("coarse_id"), "item_id").agg(F.sum("part").alias("base"))
    _, wide = _mixing(states, level_table, kappa, None, False, fine)
    rest = states.join(wide, ["state_id", "archetype_id"], "left").select("state_id", "archetype_id", coarse_id.alias("coarse_id"), (F.coalesce(1 - F.col("l0"), F.lit(1.0)) * F.coalesce(1 - F.col("l1"), F.lit(1.0))).alias("rest"))
    parts = contributions(states, level_table, kappa, which=fine).select("state_id", "archetype_id", "item_id", "part")
    parts = parts.unionByName(rest.join(base, "coarse_id").select("state_id", "archetype_id", "item_id", (F.col("rest") * F.col("base")).alias("part")))
    if mixture:
        parts = parts.join(states.select("state_id", "archetype_id", "share"), ["state_id", "archetype_id"]).withColumn("part", F.col("part") * F.col("share"))
    marked = parts.select("state_id", "item_id", "part", F.lit(0).alias("own")).unionByName(owned.select("state_id", "item_id", F.lit(0.0).alias("part"), F.lit(1).alias("own")))
    mixed = marked.repartition("state_id").groupBy("state_id", "item_id").agg(F.sum("part").alias("_p"), F.max("own").alias("own")).where("own = 0")
    return mixed.select("state_id", "item_id", F.try_divide("_p", F.sum("_p").over(Window.partitionBy("state_id"))).alias("p"))


def evidence(parts: DataFrame, decimals: int | None = None) -> DataFrame:
    """(state_id, archetype_id, item_id, p, level, n): the level that adds most (the finest on a tie) and its count.

    With ``decimals``, what the levels add is rounded before it is compared; ``p`` is the sum of exact parts."""
    part = F.col("part") if decimals is None else F.round("part", decimals)
    best = F.max(F.struct(part.alias("part"), (-F.col("level")).alias("depth"), "n"))
    return parts.groupBy("state_id", "archetype_id", "item_id").agg(F.sum("part").alias("p"), best.alias("b")).select("state_id", "archetype_id", "item_id", "p", (-F.col("b.depth")).alias("level"), F.col("b.n").alias("n"))


def best_items(chances: DataFrame, n: int = 3, decimals: int = 9) -> DataFrame:
    """(state_id, place, item_id, p): the ``n`` likeliest items of each state, ties to the smaller id.

    Chances are rounded for the ranking, so that the order does not hang on the order of addition."""
    place = F.row_number().over(Window.partitionBy("state_id").orderBy(F.desc(F.round("p", decimals)), "item_id"))
    return chances.withColumn("place", place).where(F.col("place") <= n)


def bracket_share(players: DataFrame, keys: list[str], floor: int) -> DataFrame:
    """(n, share) of distinct players with a rank, and the share of them at or above ``floor``."""
    once = players.where(F.col("average_badge").isNotNull()).select(*keys, "average_badge").distinct()
    return once.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("average_badge") >= floor).cast("double")).alias("share"))


def states_now(bought: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """One state per player: where the player stands after the last purchase."""
    order = Window.partitionBy(*keys).orderBy("step")
    rows = bought.withColumn("prev_two", F.lag("item_id", 1, NO_ITEM).over(order)).withColumn("_after", F.lead("step").over(order)).where(F.col("_after").isNull())
    rows = rows.select(*keys, F.concat_ws("/", *keys).alias("state_id"), "hero_id", "prev_two", F.col("item_id").alias("prev_one"), (F.col("step") + 1).cast("int").alias("n_owned"), time_bucket(F.col("buy_time_s")).alias("time_bucket"), "buy_time_s", "nw_at_buy")
    return rows.join(labels, keys, "left").fillna(0, ["archetype_id"])


def before_each(bought: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Every purchase as a decision: the key columns before it and ``owned``, the distinct items bought before
    (never more than the shop holds, however long the sequence)."""
    order = Window.partitionBy(*keys).orderBy("step")
    return prepared(bought.withColumn("owned", F.collect_set("item_id").over(order.rowsBetween(Window.unboundedPreceding, -1))), labels, keys)


#: Places to which parts of chances are rounded before they are ranked, so that sums do not hang on their order.
PLACES = 12


#: The key columns that the four coarse levels look at.
COARSE_KEYS = ("hero_id", "archetype_id", "n_owned", "time_bucket")


class StateTables(NamedTuple):
    """``fine``: of every distinct state (KEYS) what the two fine levels add (``fine``: item -> p), the part they
    leave (``rest``) and their sum (``own``).  ``coarse``: of every distinct coarse context (COARSE_KEYS) the mixture of the
    other levels (``coarse``: array of minus p, item, best first; ``by_item``: item -> p) and its sum (``others``).

    The chance of an item is its fine p plus ``rest`` times its coarse p.  Arrays and maps are bounded by the shop."""

    fine: DataFrame
    coarse: DataFrame


def state_tables(states: DataFrame, level_table: DataFrame, kappa: float = KAPPA) -> StateTables:
    """The tables from which the chances of ``states`` (KEYS) are read; coarse mixtures are made once per coarse context."""
    fine, coarse = (0, 1), tuple(range(2, len(LEVELS)))
    name = lambda keys: F.concat_ws("|", *(F.col(c).cast("string") for c in keys))
    totals = stored(context_totals(level_table), "totals")
    few = states.select(*COARSE_KEYS).distinct().withColumn("state_id", name(COARSE_KEYS))
    base = contributions(few, level_table, kappa, totals, which=coarse).groupBy("state_id", "item_id").agg(F.round(F.sum("part"), PLACES).alias("p"))
    base = base.groupBy("state_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("down"), F.col("item_id")))).alias("coarse"), F.map_from_entries(F.collect_list(F.struct("item_id", "p"))).alias("by_item"), F.sum("p").alias("others"))
    once = states.select(*KEYS).distinct().withColumn("state_id", name(KEYS))
    _, wide = _mixing(once, level_table, kappa, totals, False, fine)
    own = contributions(once, level_table, kappa, totals, which=fine).groupBy("state_id", "item_id").agg(F.round(F.sum("part"), PLACES).alias("p"))
    own = own.groupBy("state_id").agg(F.map_from_entries(F.collect_list(F.struct("item_id", "p"))).alias("fine"), F.sum("p").alias("own"))
    rest = (1 - F.coalesce("l0", F.lit(0.0))) * (1 - F.coalesce("l1", F.lit(0.0)))
    rows = once.join(wide.drop("archetype_id"), "state_id", "left").join(own, "state_id", "left")
    return StateTables(rows.select(*KEYS, "fine", rest.alias("rest"), "own"), few.join(base, "state_id").drop("state_id"))


def _chance(item: Column) -> Column:
    """The chance of an item, of the arrays of ``state_tables``."""
    return F.coalesce(F.try_element_at("fine", item), F.lit(0.0)) + F.col("rest") * F.coalesce(F.try_element_at("by_item", item), F.lit(0.0))


def ranked(asked: DataFrame, tables: StateTables, n: int = 3) -> DataFrame:
    """``asked`` (KEYS, owned) with ``best``: array of (down, item_id), the likeliest items not owned (at least the first
    ``n``; ties to the smaller id, ``down`` is minus the chance), and ``left``: the sum of the chances of all items not owned.

    Of the coarse mixture the first n + owned + fine items suffice: no other item can come among the first n."""
    # the long arrays of the coarse contexts come last, so that they are never shuffled with the rows
    rows = asked.join(tables.fine, list(KEYS), "left").join(tables.coarse, list(COARSE_KEYS), "left")
    rows = rows.withColumns({
        "fine": F.coalesce("fine", F.create_map().cast("map<bigint,double>")), "rest": F.coalesce("rest", F.lit(1.0)),
        "coarse": F.coalesce("coarse", F.array().cast("array<struct<down:double,item_id:bigint>>")), "whole": F.coalesce("own", F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * F.coalesce("others", F.lit(0.0)),
    })
    known = F.map_keys("fine")
    top = F.slice("coarse", 1, F.lit(n) + F.size("owned") + F.size("fine"))
    others = F.transform(F.filter(top, lambda c: ~F.array_contains(known, c["item_id"])), lambda c: F.struct((F.col("rest") * c["down"]).alias("down"), c["item_id"].alias("item_id")))
    own = F.transform(known, lambda i: F.struct((-_chance(i)).alias("down"), i.alias("item_id")))
    best = F.filter(F.array_sort(F.concat(own, others)), lambda x: ~F.array_contains("owned", x["item_id"]))
    gone = F.aggregate("owned", F.lit(0.0), lambda s, i: s + _chance(i))
    return rows.withColumn("best", best).withColumn("left", F.col("whole") - gone).drop("fine", "rest", "coarse", "by_item", "whole", "own", "others")


def hit_place(items: Column, owned: Column, bought: Column) -> Column:
    """The place of ``bought`` in a ranked array of items once the owned ones are taken out; null if it is owned already or not listed."""
    at = F.array_position(items, bought).cast("int")
    above = F.size(F.filter(F.slice(items, 1, F.greatest(at - 1, F.lit(0))), lambda x: F.array_contains(owned, x)))
    return F.when((at > 0) & ~F.array_contains(owned, bought), at - above)


def candidates(states: DataFrame, owned: DataFrame, shop: DataFrame, souls: str | None = None) -> DataFrame:
    """(state_id, item_id, cost): shop items a state may still buy.

    The shop has a few hundred rows whatever the number of states; each state gets them from a broadcast array."""
    stock = shop.select("id", F.coalesce("cost", F.lit(0)).alias("cost")).agg(F.collect_list(F.struct("id", "cost")).alias("stock"))
    rows = states.withColumn("_one", F.lit(1)).join(F.broadcast(stock.withColumn("_one", F.lit(1))), "_one").select("state_id", *([souls] if souls else []), F.explode("stock").alias("s"))
    if souls:
        rows = rows.where(F.col("s.cost") <= F.col(souls))
    return rows.select("state_id", F.col("s.id").alias("item_id"), F.col("s.cost").alias("cost")).join(owned.select("state_id", "item_id"), ["state_id", "item_id"], "left_anti")
