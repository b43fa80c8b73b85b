"""Queries that flatten the stored match pulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.operators import nested
from lanewright.plans.adapters import with_
from lanewright.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.item_entries(table(spark, folder, "raw_matches"))


def p3_players(spark: SparkSession, folder: str) -> DataFrame:
    """One row per player of the latest valid pulls, with the number of item entries."""
    tables = nested.flat_tables(table(spark, folder, "raw_matches"), "item")
    entries = tables["item"].groupBy("doc", F.col("player_pre").alias("pre")).agg(F.count(F.lit(1)).alias("n_entries"))
    return tables["player"].join(entries, ["doc", "pre"], "left").select("match_id", "player_slot", "team", "hero_id", "account_id", F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"))


QUERIES = {f.__name__: f for f in (p3_found, p3_players)}
SQL: dict[str, str] = {
    "p3_found": with_("pull_entry") + "\nSELECT match_id, player_slot, pos AS item_pos, item_id FROM pull_entry WHERE item_id IS NOT NULL",
    "p3_players": with_("pull_entry") + """,
n AS (SELECT match_id, player_slot, count(*) AS n_entries FROM pull_entry GROUP BY match_id, player_slot)
SELECT p.match_id, p.player_slot, team, hero_id, try_cast(p->>'account_id' AS bigint) AS account_id, coalesce(n_entries, 0) AS n_entries FROM pull_player p LEFT JOIN n ON p.match_id = n.match_id AND p.player_slot = n.player_slot""",
}
