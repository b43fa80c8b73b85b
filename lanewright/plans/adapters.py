"""Domain tables derived from the stored tables, and the same derivations as SQL.

``buys`` is one row per purchase that has hero, item and time; ``step`` is its
place in the seat's order of time.  Ability points and imbues come from the
stored match pulls.  Archetype labels, which the stored tables do not hold,
follow a fixed arithmetic rule, so that every operator on them can be checked
against SQL over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewright.operators import facts, nested
from lanewright.runtime import stored
from lanewright.sources.tables import table

SEAT = ["match_id", "player_slot"]


def buys(spark: SparkSession, folder: str) -> DataFrame:
    """One row per purchase; of repeated rows the smallest value of each column."""
    sound = table(spark, folder, "purchases").where("match_id is not null and player_slot is not null and hero_id is not null and item_id is not null and buy_time_s is not null")
    columns = ["account_id", "hero_id", "team", "won", "average_badge", "item_id", "buy_time_s", "nw_at_buy"]
    once = sound.groupBy(*SEAT, "buy_index").agg(*(F.min(c).alias(c) for c in columns))
    order = Window.partitionBy(*SEAT).orderBy("buy_time_s", "buy_index")
    return once.withColumn("step", F.row_number().over(order) - 1)


def items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "items")


def labels(bought: DataFrame) -> DataFrame:
    """(match_id, player_slot, archetype_id): a fixed rule, three groups."""
    return bought.select(*SEAT).distinct().withColumn("archetype_id", F.pmod(F.col("match_id") + F.col("player_slot"), F.lit(3)).cast("int"))


def pulls(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Node tables of the stored match pulls."""
    return nested.flat_tables(table(spark, folder, "raw_matches"), *names)


def slots(flat: dict[str, DataFrame], shop: DataFrame) -> DataFrame:
    """(hero_id, ability_id, signature_slot): the stored tables name no slots, so the abilities that a hero's
    players put points into are numbered by id; only the first four have a slot."""
    rest = flat["item"].where("item_id is not null and player_hero is not null").join(F.broadcast(shop.select(F.col("id").alias("item_id"))), "item_id", "left_anti")
    known = rest.select(F.col("player_hero").alias("hero_id"), F.col("item_id").alias("ability_id")).distinct()
    nth = F.row_number().over(Window.partitionBy("hero_id").orderBy("ability_id"))
    return known.withColumn("signature_slot", nth).where("signature_slot <= 4")


def points(spark: SparkSession, folder: str, flat: dict[str, DataFrame] | None = None) -> DataFrame:
    """Ability points of the latest pulls; ``flat``: their node tables, for callers that have them."""
    flat, shop = flat or pulls(spark, folder, "item"), items(spark, folder)
    return facts.point_facts(flat, shop, stored(slots(flat, shop), "slots"))


def imbues(spark: SparkSession, folder: str, flat: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Imbued purchases of the latest pulls, and the players (hero_id, seat) who bought anything."""
    flat, shop = flat or pulls(spark, folder, "item"), items(spark, folder)
    imbueable = shop.where("imbue is not null").select(F.col("id").alias("item_id"), F.col("imbue").alias("imbue_group"))
    seat = facts.seats(flat).select("doc", "player_pre", "hero_id", *SEAT)
    players = seat.join(facts.purchases(flat, shop).select("doc", "player_pre"), ["doc", "player_pre"], "left_semi").select("hero_id", *SEAT).distinct()
    return facts.imbue_facts(flat, imbueable, stored(slots(flat, shop), "slots")), players


#: The derivations as common table expressions; ``with_()`` picks what a query needs.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "buys": (
        (),
        """SELECT *, row_number() OVER (PARTITION BY match_id, player_slot ORDER BY buy_time_s, buy_index) - 1 AS step FROM (
  SELECT match_id, player_slot, buy_index, min(account_id) AS account_id, min(hero_id) AS hero_id, min(team) AS team, min(won) AS won,
    min(average_badge) AS average_badge, min(item_id) AS item_id, min(buy_time_s) AS buy_time_s, min(nw_at_buy) AS nw_at_buy
  FROM purchases WHERE match_id IS NOT NULL AND player_slot IS NOT NULL AND hero_id IS NOT NULL AND item_id IS NOT NULL AND buy_time_s IS NOT NULL
  GROUP BY match_id, player_slot, buy_index)""",
    ),
    "labels": (("buys",), "SELECT DISTINCT match_id, player_slot, ((match_id + player_slot) % 3)::int AS archetype_id FROM buys"),
    "pull_node": (
        (),
        """SELECT raw_id, pulled_at, unnest(ms) AS m, generate_subscripts(ms, 1) AS pos FROM (
  SELECT raw_id, pulled_at, CASE WHEN json_type(j) = 'ARRAY' THEN from_json(j, '["JSON"]') WHEN (j->'match_id') IS NOT NULL THEN [j]
    WHEN (j->'match_info') IS NOT NULL THEN [j->'match_info'] WHEN json_type(j->'data') = 'ARRAY' THEN from_json(j->'data', '["JSON"]') END AS ms FROM (
    SELECT raw_id, pulled_at, CASE WHEN json_type(payload) = 'VARCHAR' THEN (payload::json->>'$')::json ELSE payload::json END AS j FROM raw_matches WHERE json_valid(payload)))""",
    ),
    "pull_match": (
        ("pull_node",),
        """SELECT match_id, m FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY pulled_at DESC NULLS LAST, raw_id DESC, pos DESC) AS nth FROM (
  SELECT *, try_cast(m->>'match_id' AS bigint) AS match_id FROM pull_node)) WHERE match_id IS NOT NULL AND nth = 1""",
    ),
    "pull_player": (
        ("pull_match",),
        """SELECT match_id, m, u.p AS p, coalesce(try_cast(u.p->>'player_slot' AS bigint), try_cast(u.k AS bigint))::int AS player_slot, try_cast(u.p->>'hero_id' AS bigint) AS hero_id, (u.p->>'team') AS team,
    try_cast(m->>'average_badge' AS bigint) AS average_badge FROM (
  SELECT match_id, m, unnest(CASE json_type(m->'players') WHEN 'ARRAY' THEN list_transform(from_json(m->'players', '["JSON"]'), lambda x: {'k': NULL::varchar, 'p': x})
    WHEN 'OBJECT' THEN list_transform(json_keys(m->'players'), lambda k: {'k': k, 'p': json_extract(m->'players', concat('$."', k, '"'))}) END) AS u FROM pull_match) WHERE json_type(u.p) = 'OBJECT'""",
    ),
    "pull_entry": (
        ("pull_player",),
        """SELECT match_id, player_slot, hero_id, average_badge, pos - 1 AS pos, try_cast(e->>'item_id' AS bigint) AS item_id, try_cast(e->>'game_time_s' AS bigint) AS game_time_s, try_cast(e->>'sold_time_s' AS bigint) AS sold_time_s,
    try_cast(e->>'upgrade_info' AS bigint) AS upgrade_info, coalesce(nullif(try_cast(e->>'imbued_ability_id' AS bigint), 0), nullif(try_cast(e->'imbue'->'target'->>'ability_id' AS bigint), 0)) AS target FROM (
  SELECT * EXCLUDE es, unnest(es) AS e, generate_subscripts(es, 1) AS pos FROM (SELECT * EXCLUDE i, CASE json_type(i) WHEN 'ARRAY' THEN from_json(i, '["JSON"]') WHEN 'OBJECT' THEN [i] END AS es FROM (
    SELECT *, CASE WHEN json_type(p->'items') = 'VARCHAR' AND json_valid(p->>'items') THEN (p->>'items')::json ELSE p->'items' END AS i FROM pull_player))) WHERE json_type(e) = 'OBJECT'""",
    ),
    "slots": (
        ("pull_entry",),
        """SELECT * FROM (SELECT hero_id, ability_id, row_number() OVER (PARTITION BY hero_id ORDER BY ability_id)::int AS signature_slot FROM (
  SELECT DISTINCT hero_id, item_id AS ability_id FROM pull_entry WHERE hero_id IS NOT NULL AND item_id IS NOT NULL AND item_id NOT IN (SELECT id FROM items))) WHERE signature_slot <= 4""",
    ),
    "points": (
        ("slots",),
        """SELECT match_id, player_slot, e.hero_id, average_badge, ability_id, coalesce(signature_slot, -1) AS signature_slot, level, game_time_s, row_number() OVER (PARTITION BY match_id, player_slot ORDER BY game_time_s, pos) - 1 AS step FROM (
  SELECT match_id, player_slot, hero_id, average_badge, pos, item_id AS ability_id, CASE upgrade_info >> 16 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 7 THEN 3 WHEN 15 THEN 4 ELSE 0 END AS level, coalesce(game_time_s, 0) AS game_time_s
  FROM pull_entry WHERE item_id IS NOT NULL AND item_id NOT IN (SELECT id FROM items)) e LEFT JOIN slots USING (hero_id, ability_id)""",
    ),
    "imbues": (
        ("slots",),
        """SELECT match_id, player_slot, e.hero_id, item_id, target AS imbued_ability_id, coalesce(signature_slot, -1) AS signature_slot, imbue AS imbue_group, coalesce(game_time_s, 0) AS game_time_s
  FROM pull_entry e JOIN items i ON e.item_id = i.id AND i.imbue IS NOT NULL LEFT JOIN slots s ON e.hero_id = s.hero_id AND e.target = s.ability_id WHERE target IS NOT NULL""",
    ),
    "players": (("pull_entry",), "SELECT DISTINCT hero_id, match_id, player_slot FROM pull_entry WHERE game_time_s IS NOT NULL AND item_id IN (SELECT id FROM items)"),
}


def with_(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the named derivations and what they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in CTES[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
