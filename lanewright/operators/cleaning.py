"""Row-level cleaning of matches and players, and net worth over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width and number of phases; bounds of the time buckets, in seconds.
PHASE_S, PHASES = 600, 4
TIME_BOUNDS = (300, 600, 900, 1200, 1800)


def player_won(player_outcome: Column, team: Column, winning_team: Column, match_outcome: Column) -> Column:
    """True, False, or null where the result does not count."""
    return (
        F.when(player_outcome == "Win", True)
        .when(player_outcome.isin("Loss", "Penalized", "PenalizedParty"), False)
        .when(player_outcome.isin("Invalid", "NotScored"), None)
        .when(winning_team.isNull() | (winning_team == "Spectator") | (team == "Spectator"), None)
        .when(match_outcome.isNotNull() & (match_outcome != "TeamWin"), None)
        .otherwise(team == winning_team)
    )


def phase_of(seconds: Column) -> Column:
    """Phase 0..3; the last is open."""
    return F.least(F.greatest(F.floor(seconds / PHASE_S), F.lit(0)), F.lit(PHASES - 1)).cast("int")


def time_bucket(seconds: Column) -> Column:
    """Number of bounds at or below ``seconds``: buckets are open to the right."""
    return sum(((seconds >= b).cast("int") for b in TIME_BOUNDS[1:]), (seconds >= TIME_BOUNDS[0]).cast("int"))


def killed_at(seconds: Column) -> Column:
    """Null for the values that stand for "never" (0 and 1)."""
    return F.when(seconds > 1, seconds)


def known_id(value: Column) -> Column:
    """Null for 0."""
    return F.nullif(value, F.lit(0))


def in_scope(entries: DataFrame, players: DataFrame, shop: DataFrame, keys: list[str], won: str = "won") -> DataFrame:
    """Players whose result counts and who bought at least one shop item."""
    bought = entries.join(shop.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    return players.where(F.col(won).isNotNull()).join(bought.select(*keys), keys, "left_semi")


def curve(samples: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """(keys, t0, w0, t1, w1): straight pieces through the samples of each key, from (0, 0); the last is flat.

    Samples at equal times count once, with the smallest value.
    """
    dots = samples.where(F.col(time).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, F.col(time).cast("double").alias("t0")).agg(F.min(F.col(value).cast("double")).alias("w0"))
    start = dots.groupBy(*keys).agg(F.min("t0").alias("first")).where(F.col("first") > 0).select(*keys, F.lit(0.0).alias("t0"), F.lit(0.0).alias("w0"))
    after = Window.partitionBy(*keys).orderBy("t0")
    return dots.unionByName(start).select(*keys, "t0", "w0", F.lead("t0").over(after).alias("t1"), F.lead("w0").over(after).alias("w1"))


def value_at(pieces: DataFrame, at: DataFrame, keys: list[str], time: str, name: str) -> DataFrame:
    """``at`` with the curve's value at ``time``; before the first piece the first value, null without a curve."""
    first = pieces.groupBy(*keys).agg(F.min_by("w0", "t0").alias("_first"))
    t = F.col(time)
    inside = (t >= F.col("t0")) & (F.col("t1").isNull() | (t < F.col("t1")))
    hit = at.join(pieces, keys, "inner").where(inside)
    line = F.col("w0") + F.coalesce((F.col("w1") - F.col("w0")) * F.try_divide(t - F.col("t0"), F.col("t1") - F.col("t0")), F.lit(0.0))
    hit = hit.select(*at.columns, line.alias("_value"))
    rows = at.join(hit.select(*keys, time, "_value").dropDuplicates([*keys, time]), [*keys, time], "left").join(first, keys, "left")
    return rows.withColumn(name, F.coalesce("_value", "_first")).drop("_value", "_first")


def match_position(values: DataFrame, match: list[str], team: str, value: str) -> DataFrame:
    """Each row's standing within its match: ratio to the match median, to the team's and the
    enemies' mean, and the share of others strictly below.  A match is a handful of players."""
    every = Window.partitionBy(*match)
    own = Window.partitionBy(*match, team)
    n, n_own = F.count(value).over(every), F.count(value).over(own)
    total, total_own = F.sum(value).over(every), F.sum(value).over(own)
    safe = lambda c: F.when(c == 0, 1.0).otherwise(c)
    enemies = F.try_divide(total - total_own, n - n_own)
    below = F.rank().over(every.orderBy(value)) - 1
    return (
        values.withColumn("vs_median", F.col(value) / safe(F.median(value).over(every)))
        .withColumn("vs_team", F.col(value) / safe(F.avg(value).over(own)))
        .withColumn("vs_enemies", F.col(value) / safe(enemies))
        .withColumn("rank_share", below / F.greatest(n - 1, F.lit(1)))
    )


def team_state(objectives: DataFrame, bosses: DataFrame, match: str = "match_id") -> DataFrame:
    """(match, team, kill_1, kill_2, kill_3, boss_s): when a team destroyed its first three
    enemy guards (the stored team is the loser) and first claimed the boss (claimed, else killed)."""
    other = F.when(F.col("loser") == "Team0", "Team1").when(F.col("loser") == "Team1", "Team0")
    kills = objectives.where(F.col("team_objective").startswith("Tier2Lane")).select(match, other.alias("team"), killed_at(F.col("destroyed_time_s")).alias("at")).where(F.col("at").isNotNull() & F.col("team").isNotNull())
    nth = F.row_number().over(Window.partitionBy(match, "team").orderBy("at"))
    three = kills.withColumn("nth", nth).groupBy(match, "team").agg(*(F.max(F.when(F.col("nth") == k, F.col("at"))).alias(f"kill_{k}") for k in (1, 2, 3)))
    boss = bosses.select(match, F.coalesce("team_claimed", "team_killed").alias("team"), killed_at(F.col("boss_time_s")).alias("at")).where(F.col("team").isNotNull()).groupBy(match, "team").agg(F.min("at").alias("boss_s"))
    return three.join(boss, [match, "team"], "full")
