"""Advice for one state of a game, and where its numbers come from."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.operators import backoff
from lanewright.operators.cleaning import TIME_BOUNDS, time_bucket

#: Observations below which evidence is thin, names of the levels, points a slot takes.
THIN, TOP = 30, 4
LEVEL_NAMES = ("last two", "last one", "count and time", "count", "hero count", "hero")


def target_badge(text: str) -> float | None:
    """A rank to weight towards; None for ``all``."""
    return None if text.strip().lower() == "all" else float(text)


def badge_label(badge: float | None) -> str:
    return "all badges" if badge is None else f"badge ~{badge:g}"


def badge_tier(badge: Column) -> Column:
    """A badge's tier: its tens."""
    return F.floor(badge / 10).cast("int")


def with_tier_names(players: DataFrame, ranks: DataFrame, badge: str = "average_badge") -> DataFrame:
    """``players`` with ``tier`` and ``tier_name`` (null above the last tier) from a small table (tier, name)."""
    return players.withColumn("tier", badge_tier(F.col(badge))).join(F.broadcast(ranks.select("tier", F.col("name").alias("tier_name"))), "tier", "left")


@dataclass(frozen=True)
class State:
    """What is known at a moment of a game; ``bought`` in order.  ``shares``: how likely each archetype is."""

    hero_id: int
    time_s: float
    souls: int | None = None
    bought: tuple[int, ...] = ()
    shares: dict[int, float] = field(default_factory=lambda: {0: 1.0})

    def after(self, item: int, time_s: float | None = None) -> State:
        return replace(self, bought=(*self.bought, item), time_s=self.time_s if time_s is None else time_s)

    @property
    def bucket(self) -> int:
        return sum(self.time_s >= b for b in TIME_BOUNDS)

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per archetype: the key columns, ``state_id``, ``share``, ``owned``."""
        last = (backoff.NO_ITEM, backoff.NO_ITEM, *self.bought)[-2:]
        rows = [("now", self.hero_id, a, last[0], last[1], len(self.bought), float(self.time_s), p, sorted(set(self.bought))) for a, p in self.shares.items()]
        df = spark.createDataFrame(rows, "state_id string, hero_id int, archetype_id int, prev_two long, prev_one long, n_owned int, time_s double, share double, owned array<bigint>")
        return df.withColumn("time_bucket", time_bucket(F.col("time_s")))


def level_name(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVEL_NAMES)), level + 1)


def advise(state: State, level_table: DataFrame, shop: DataFrame, n: int = 5, masked: bool = True) -> DataFrame:
    """(place, item_id, name, p, level, n, cost, thin): the likeliest items that the state can still buy (cost within
    its souls, if known), with the level that says most and its observations."""
    spark = level_table.sparkSession
    states = state.frame(spark)
    owned = states.select("state_id", F.explode("owned").alias("item_id")).distinct() if masked else spark.createDataFrame([], "state_id string, item_id long")
    chances = backoff.distribution(states, level_table, owned, mixture=True)
    likely = max(state.shares, key=lambda a: (state.shares[a], -a))
    told = backoff.evidence(backoff.contributions(states.where(F.col("archetype_id") == likely), level_table))
    stock = F.broadcast(shop.select(F.col("id").alias("item_id"), "name", F.coalesce("cost", F.lit(0)).alias("cost")))
    rows = chances.join(stock, "item_id").join(told.select("item_id", "level", "n"), "item_id", "left")
    if state.souls is not None:
        rows = rows.where(F.col("cost") <= state.souls)
    best = backoff.best_items(rows, n)
    return best.select("place", "item_id", "name", "p", level_name(F.col("level")).alias("level"), F.coalesce("n", F.lit(0)).alias("n"), "cost", (F.coalesce("n", F.lit(0)) < THIN).alias("thin"))


def explained(state: State, level_table: DataFrame, item: int, kappa: float = backoff.KAPPA) -> DataFrame:
    """(level, name, ctx, n, lambda, local, part) of an item, one row per level, finest first, for the likeliest archetype."""
    likely = max(state.shares, key=lambda a: (state.shares[a], -a))
    states = state.frame(level_table.sparkSession).where(F.col("archetype_id") == likely)
    asked = states.select(F.explode(F.array(*(F.struct(F.lit(k).alias("level"), backoff.context(k).alias("ctx")) for k in range(len(backoff.LEVELS))))).alias("c")).select("c.level", "c.ctx")
    seen = level_table.join(F.broadcast(asked), ["level", "ctx"]).groupBy("level", "ctx").agg(F.sum("w").alias("_w"), F.sum("n").alias("n"), F.sum(F.when(F.col("item_id") == item, F.col("w"))).alias("_own"))
    parts = backoff.contributions(states, level_table, kappa).where(F.col("item_id") == item).select("level", "part")
    rows = asked.join(seen, ["level", "ctx"], "left").join(parts, "level", "left")
    return rows.select(
        "level", level_name(F.col("level")).alias("name"), "ctx", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("_w") / (F.col("_w") + kappa), F.lit(0.0)).alias("lambda"),
        F.coalesce(F.try_divide("_own", "_w"), F.lit(0.0)).alias("local"), F.coalesce("part", F.lit(0.0)).alias("part"),
    ).orderBy("level")


def advise_points(state: State, level_table: DataFrame, slots: DataFrame, levels: dict[int, int] | None = None, n: int = 4) -> DataFrame:
    """(place, slot, name, level, p, by, n, thin): the likeliest next ability points; slots (signature_slot, name) at the top level are left out."""
    levels = levels or {}
    open_ = [(s, levels.get(s, 0) + 1) for s in range(1, 5) if levels.get(s, 0) < TOP]
    spark = level_table.sparkSession
    own = spark.createDataFrame(open_, "signature_slot int, level int").join(slots.select("signature_slot", "name"), "signature_slot")
    told = advise(state, level_table, own.select(F.col("signature_slot").cast("long").alias("id"), "name", F.lit(0).alias("cost")), n, masked=False)
    return told.select("place", F.col("item_id").cast("int").alias("slot"), "name", "p", F.col("level").alias("by"), "n", "thin").join(own.select(F.col("signature_slot").alias("slot"), "level"), "slot").orderBy("place")


def point_line(position: Column, name: Column, level: Column, time_s: Column, p: Column, n: Column) -> Column:
    """An ability point as a line of text."""
    line = F.format_string("%2d. %-22s -> level %d  ~%dmin  p=%.3f (n=%d)", position + 1, name, level, F.floor(time_s / 60).cast("int"), p, n)
    return F.concat(line, F.when(n < THIN, "  [thin]").otherwise(""))
