"""Queries on cleaning, splits, ability points and spending, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewright.operators import cleaning, economy, facts, points, ranking, splitting
from lanewright.operators.evaluation import prevalence
from lanewright.plans import adapters
from lanewright.plans.adapters import SEAT, with_
from lanewright.runtime import stored
from lanewright.sources.tables import table
from lanewright.streaming import purchases as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    """SELECT match_id, player_slot, CASE WHEN o = 'Win' THEN true WHEN o IN ('Loss', 'Penalized', 'PenalizedParty') THEN false WHEN o IN ('Invalid', 'NotScored') THEN NULL
  WHEN winning = 'Spectator' OR team = 'Spectator' OR winning IS NULL THEN NULL WHEN kind <> 'TeamWin' THEN NULL ELSE team = winning END AS won
FROM (SELECT match_id, player_slot, team,
  CASE match_id % 11 WHEN 0 THEN 'Win' WHEN 1 THEN 'Loss' WHEN 2 THEN 'Penalized' WHEN 3 THEN 'Invalid' WHEN 4 THEN 'NotScored' WHEN 5 THEN 'PenalizedParty' ELSE NULL END AS o,
  CASE WHEN match_id % 13 = 0 THEN NULL WHEN match_id % 13 = 1 THEN 'Spectator' WHEN match_id % 2 = 0 THEN 'Team0' ELSE 'Team1' END AS winning,
  CASE WHEN match_id % 17 = 0 THEN 'Error' ELSE 'TeamWin' END AS kind
  FROM (SELECT match_id, player_slot, min(team) AS team FROM purchases WHERE match_id IS NOT NULL AND player_slot IS NOT NULL GROUP BY match_id, player_slot))"""
)
def player_outcome(spark: SparkSession, folder: str) -> DataFrame:
    seats = table(spark, folder, "purchases").where("match_id is not null and player_slot is not null").groupBy(*SEAT).agg(F.min("team").alias("team"))
    m = F.col("match_id")
    told = F.when(m % 11 == 0, "Win").when(m % 11 == 1, "Loss").when(m % 11 == 2, "Penalized").when(m % 11 == 3, "Invalid").when(m % 11 == 4, "NotScored").when(m % 11 == 5, "PenalizedParty")
    winning = F.when(m % 13 == 0, None).when(m % 13 == 1, "Spectator").when(m % 2 == 0, "Team0").otherwise("Team1")
    return seats.select(*SEAT, cleaning.player_won(told, F.col("team"), winning, F.when(m % 17 == 0, "Error").otherwise("TeamWin")).alias("won"))


@query(
    with_("buys")
    + """
SELECT least(greatest(floor(buy_time_s / 600), 0), 3)::int AS phase, (buy_time_s >= 300)::int + (buy_time_s >= 600)::int + (buy_time_s >= 900)::int + (buy_time_s >= 1200)::int + (buy_time_s >= 1800)::int AS time_bucket,
  count(*) AS n, count(DISTINCT match_id) AS n_matches FROM buys GROUP BY 1, 2"""
)
def phases_and_buckets(spark: SparkSession, folder: str) -> DataFrame:
    rows = adapters.buys(spark, folder).withColumn("phase", cleaning.phase_of(F.col("buy_time_s"))).withColumn("time_bucket", cleaning.time_bucket(F.col("buy_time_s")))
    return rows.groupBy("phase", "time_bucket").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("match_id").alias("n_matches"))


@query(
    with_("buys")
    + """
SELECT match_id, player_slot, buy_index, greatest(ceil(5 * (rn - 1) / greatest(n - 1, 1)) - 1, 0)::int AS nw_quintile FROM (
  SELECT *, row_number() OVER (PARTITION BY phase ORDER BY nw_at_buy NULLS FIRST, match_id, player_slot, buy_index) AS rn, count(*) OVER (PARTITION BY phase) AS n
  FROM (SELECT *, least(greatest(floor(buy_time_s / 600), 0), 3)::int AS phase FROM buys))"""
)
def nw_quintile(spark: SparkSession, folder: str) -> DataFrame:
    rows = adapters.buys(spark, folder).select(*SEAT, "buy_index", "nw_at_buy", cleaning.phase_of(F.col("buy_time_s")).alias("phase"))
    ranked = ranking.global_rank(rows, ["phase"], ["nw_at_buy", *SEAT, "buy_index"])
    return ranked.select(*SEAT, "buy_index", ranking.quantile_bucket(F.col("rank"), F.col("rank_n")).alias("nw_quintile"))


#: Net worth of every seat at three times, by straight lines through its purchases.
NETWORTH = """dots AS (SELECT match_id, player_slot, buy_time_s AS t0, min(nw_at_buy) AS w0 FROM buys WHERE nw_at_buy IS NOT NULL GROUP BY match_id, player_slot, buy_time_s),
full_dots AS (SELECT * FROM dots UNION ALL SELECT match_id, player_slot, 0.0, 0.0 FROM dots GROUP BY match_id, player_slot HAVING min(t0) > 0),
pieces AS (SELECT *, lead(t0) OVER w AS t1, lead(w0) OVER w AS w1 FROM full_dots WINDOW w AS (PARTITION BY match_id, player_slot ORDER BY t0)),
networth AS (SELECT p.match_id, p.player_slot, a.at_s, w0 + coalesce((w1 - w0) * (a.at_s - t0) / (t1 - t0), 0) AS nw FROM pieces p, (VALUES (300.0::double), (900.0::double), (1500.0::double)) a(at_s)
  WHERE a.at_s >= t0 AND (t1 IS NULL OR a.at_s < t1))"""


def _networth(spark: SparkSession, folder: str) -> DataFrame:
    rows = adapters.buys(spark, folder)
    pieces = cleaning.curve(rows, SEAT, "buy_time_s", "nw_at_buy")
    at = rows.where("nw_at_buy is not null").select(*SEAT).distinct().withColumn("at_s", F.explode(F.array(*(F.lit(float(t)) for t in (300, 900, 1500)))))
    return cleaning.value_at(pieces, at, SEAT, "at_s", "nw")


@query(with_("buys") + ",\n" + NETWORTH + "\nSELECT match_id, player_slot, at_s, round(nw, 6) AS nw FROM networth")
def networth_at(spark: SparkSession, folder: str) -> DataFrame:
    return _networth(spark, folder).select(*SEAT, "at_s", F.round("nw", 6).alias("nw"))


@query(
    with_("buys")
    + ",\n"
    + NETWORTH
    + """,
seats AS (SELECT match_id, player_slot, min(team) AS team FROM buys GROUP BY match_id, player_slot),
v AS (SELECT n.*, s.team FROM networth n JOIN seats s USING (match_id, player_slot)),
w AS (SELECT *, median(nw) OVER m AS med, avg(nw) OVER o AS own, sum(nw) OVER m - sum(nw) OVER o AS rest, count(*) OVER m - count(*) OVER o AS n_rest, count(*) OVER m AS n, rank() OVER (PARTITION BY match_id, at_s ORDER BY nw) - 1 AS below
  FROM v WINDOW m AS (PARTITION BY match_id, at_s), o AS (PARTITION BY match_id, at_s, team))
SELECT match_id, player_slot, at_s, round(nw / CASE WHEN med = 0 THEN 1 ELSE med END, 6) AS vs_median, round(nw / CASE WHEN own = 0 THEN 1 ELSE own END, 6) AS vs_team,
  round(nw / CASE WHEN rest / nullif(n_rest, 0) = 0 THEN 1 ELSE rest / nullif(n_rest, 0) END, 6) AS vs_enemies, round(below / greatest(n - 1, 1), 6) AS rank_share FROM w"""
)
def match_position(spark: SparkSession, folder: str) -> DataFrame:
    seats = adapters.buys(spark, folder).groupBy(*SEAT).agg(F.min("team").alias("team"))
    told = cleaning.match_position(_networth(spark, folder).join(seats, SEAT), ["match_id", "at_s"], "team", "nw")
    return told.select(*SEAT, "at_s", *(F.round(c, 6).alias(c) for c in ("vs_median", "vs_team", "vs_enemies", "rank_share")))


#: Times at which each team destroyed its first three enemy guards, and first claimed the boss.
TEAM_STATE = """kills AS (SELECT match_id, CASE (o->>'team') WHEN 'Team0' THEN 'Team1' WHEN 'Team1' THEN 'Team0' END AS team, try_cast(o->>'destroyed_time_s' AS bigint) AS secs FROM (
    SELECT match_id, unnest(from_json(m->'objectives', '["JSON"]')) AS o FROM pull_match WHERE json_type(m->'objectives') = 'ARRAY') WHERE starts_with(o->>'team_objective', 'Tier2Lane')),
three AS (SELECT match_id, team, max(secs) FILTER (nth = 1) AS kill_1, max(secs) FILTER (nth = 2) AS kill_2, max(secs) FILTER (nth = 3) AS kill_3 FROM (
    SELECT *, row_number() OVER (PARTITION BY match_id, team ORDER BY secs) AS nth FROM kills WHERE secs > 1 AND team IS NOT NULL) GROUP BY match_id, team),
boss AS (SELECT match_id, team, min(CASE WHEN secs > 1 THEN secs END) AS boss_s FROM (SELECT match_id, coalesce(b->>'team_claimed', b->>'team_killed') AS team, try_cast(b->>'destroyed_time_s' AS bigint) AS secs FROM (
    SELECT match_id, unnest(from_json(m->'mid_boss', '["JSON"]')) AS b FROM pull_match WHERE json_type(m->'mid_boss') = 'ARRAY')) WHERE team IS NOT NULL GROUP BY match_id, team),
team_state AS (SELECT coalesce(t.match_id, b.match_id) AS match_id, coalesce(t.team, b.team) AS team, kill_1, kill_2, kill_3, boss_s FROM three t FULL JOIN boss b ON t.match_id = b.match_id AND t.team = b.team)"""


@query(with_("pull_match") + ",\n" + TEAM_STATE + "\nSELECT * FROM team_state")
def team_match_state(spark: SparkSession, folder: str) -> DataFrame:
    """First three guard kills and first boss of each team in the latest pull of each match."""
    flat = adapters.pulls(spark, folder, "objective", "boss")
    return cleaning.team_state(flat["objective"], flat["boss"])


@query(with_("pull_entry") + "\nSELECT match_id, player_slot, item_id, game_time_s, row_number() OVER (PARTITION BY match_id, player_slot ORDER BY game_time_s NULLS FIRST, pos) - 1 AS buy_index FROM pull_entry WHERE item_id IN (SELECT id FROM items)")
def clean_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Shop items bought in the latest pulls, in order of time; the complement are ability points."""
    flat = adapters.pulls(spark, folder, "item")
    bought = flat["item"].join(F.broadcast(adapters.items(spark, folder).select(F.col("id").alias("item_id"))), "item_id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc", "player_pre").orderBy("game_time_s", "pos")) - 1
    return bought.select("match_id", "player_slot", "item_id", "game_time_s", nth.alias("buy_index"))


@query(with_("points") + "\nSELECT match_id, player_slot, hero_id, average_badge, ability_id, signature_slot, level, game_time_s, step FROM points")
def point_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the latest pulls that are no shop items, with slot and the level their bit mask stands for."""
    return adapters.points(spark, folder)


@query(with_("imbues") + "\nSELECT * FROM imbues")
def imbue_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Imbued purchases of the latest pulls, with the slot they aim at."""
    return adapters.imbues(spark, folder)[0]


@query(with_("pull_entry") + "\nSELECT count(i.id) AS n_purchases, sum((i.id IS NULL)::int)::bigint AS n_points, count(*) AS n_entries, true AS ok FROM pull_entry e LEFT JOIN items i ON e.item_id = i.id WHERE item_id IS NOT NULL")
def entry_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases and ability points must add up to all entries."""
    return facts.reconciled(adapters.pulls(spark, folder, "item"), adapters.items(spark, folder))


#: The fact rows: every curve as lists of times and values, read off by the same straight lines.
FACTS = TEAM_STATE + """,
dots AS (SELECT match_id, player_slot, t, w FROM (SELECT match_id, player_slot, try_cast(s->>'time_stamp_s' AS double) AS t, try_cast(s->>'net_worth' AS double) AS w FROM (
    SELECT match_id, player_slot, unnest(from_json(p->'stats', '["JSON"]')) AS s FROM pull_player WHERE json_type(p->'stats') = 'ARRAY')) WHERE t IS NOT NULL AND w IS NOT NULL),
shape AS (SELECT p.match_id, p.player_slot, p.team, list(t ORDER BY t, w) FILTER (t IS NOT NULL) AS ts, list(w ORDER BY t, w) FILTER (t IS NOT NULL) AS ws FROM pull_player p LEFT JOIN dots d ON p.match_id = d.match_id AND p.player_slot = d.player_slot GROUP BY ALL),
shape0 AS (SELECT match_id, player_slot, team, CASE WHEN ts IS NULL THEN [0.0::double] WHEN ts[1] > 0 THEN list_prepend(0.0::double, ts) ELSE ts END AS ts, CASE WHEN ts IS NULL THEN [0.0::double] WHEN ts[1] > 0 THEN list_prepend(0.0::double, ws) ELSE ws END AS ws FROM shape),
got AS (SELECT e.match_id, e.player_slot, item_id, game_time_s AS t, pos, coalesce(sold_time_s, 0) AS sold_time_s, row_number() OVER (PARTITION BY e.match_id, e.player_slot ORDER BY game_time_s, pos) - 1 AS buy_index
    FROM pull_entry e WHERE item_id IN (SELECT id FROM items) AND game_time_s IS NOT NULL),
near AS (SELECT g.*, s.player_slot AS other, s.team AS other_team, ts, ws, len(list_filter(ts, lambda x: x <= g.t)) AS k FROM got g JOIN shape0 s ON g.match_id = s.match_id),
then_ AS (SELECT *, CASE WHEN k = 0 THEN ws[1] WHEN k = len(ts) THEN ws[k] ELSE ws[k] + coalesce((ws[k + 1] - ws[k]) * (t - ts[k]) / nullif(ts[k + 1] - ts[k], 0), 0) END AS w FROM near),
own AS (SELECT match_id, player_slot, buy_index, w AS nw, other_team AS team FROM then_ WHERE other = player_slot),
told AS (SELECT n.match_id, n.player_slot, n.buy_index, any_value(o.nw) AS nw, any_value(o.team) AS team, median(w) AS med, avg(w) FILTER (coalesce(other_team = o.team, false)) AS own, avg(w) FILTER (NOT coalesce(other_team = o.team, false)) AS enemy,
    sum((w < o.nw)::int) / greatest(count(*) - 1, 1) AS below FROM then_ n JOIN own o ON n.match_id = o.match_id AND n.player_slot = o.player_slot AND n.buy_index = o.buy_index GROUP BY n.match_id, n.player_slot, n.buy_index),
seat AS (SELECT match_id, player_slot, hero_id, team, average_badge, try_cast(p->>'account_id' AS bigint) AS account_id, try_cast(p->>'assigned_lane' AS bigint) AS assigned_lane, try_cast(p->>'net_worth' AS bigint) AS final_net_worth,
    nullif(try_cast(p->>'hero_build_id' AS bigint), 0) AS hero_build_id, nullif(try_cast(p->>'pregame_hero_id' AS bigint), 0) AS pregame_hero_id, try_cast(m->>'duration_s' AS bigint) AS duration_s, coalesce(json_type(m->'objectives') <> 'NULL', false) AS has_objectives,
    CASE WHEN (p->>'player_match_outcome') = 'Win' THEN true WHEN (p->>'player_match_outcome') IN ('Loss', 'Penalized', 'PenalizedParty') THEN false WHEN (p->>'player_match_outcome') IN ('Invalid', 'NotScored') THEN NULL
      WHEN (m->>'winning_team') IS NULL OR (m->>'winning_team') = 'Spectator' OR team = 'Spectator' OR (m->>'match_outcome') <> 'TeamWin' THEN NULL ELSE team = (m->>'winning_team') END AS won FROM pull_player),
facts AS (SELECT s.*, kill_1, kill_2, kill_3, boss_s, item_id, g.t AS buy_time_s, least(greatest(floor(g.t / 600), 0), 3)::int AS phase, g.buy_index, g.sold_time_s <> 0 AS sold, g.sold_time_s, round(nw, 6) AS nw_at_buy,
    round(nw / CASE WHEN coalesce(med, 1) = 0 THEN 1 ELSE coalesce(med, 1) END, 6) AS nw_vs_match_median, round(nw / CASE WHEN coalesce(own, 1) = 0 THEN 1 ELSE coalesce(own, 1) END, 6) AS nw_vs_team_avg,
    round(nw / CASE WHEN coalesce(enemy, 1) = 0 THEN 1 ELSE coalesce(enemy, 1) END, 6) AS nw_vs_enemy_avg, round(below, 6) AS nw_rank_in_match
  FROM got g JOIN told USING (match_id, player_slot, buy_index) JOIN seat s ON s.match_id = g.match_id AND s.player_slot = g.player_slot LEFT JOIN team_state ts ON ts.match_id = s.match_id AND ts.team = s.team WHERE won IS NOT NULL)"""
ROUNDED = ("nw_at_buy", "nw_vs_match_median", "nw_vs_team_avg", "nw_vs_enemy_avg", "nw_rank_in_match")


@query(with_("pull_entry") + ",\n" + FACTS + "\nSELECT *, greatest(ceil(5 * (rn - 1) / greatest(n - 1, 1)) - 1, 0)::int AS nw_quintile FROM (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY nw_at_buy, match_id, player_slot, buy_index) AS rn, count(*) OVER (PARTITION BY phase) AS n FROM facts)".replace("SELECT *, greatest", "SELECT * EXCLUDE (rn, n), greatest"))
def purchase_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The purchase table from the latest pulls: one row per purchase, with the state of player, team and match."""
    told = facts.purchase_facts(adapters.pulls(spark, folder), adapters.items(spark, folder))
    return facts.with_quintiles(told.select(*(F.round(c, 6).alias(c) if c in ROUNDED else F.col(c) for c in told.columns)))


def _split_sql(key: str, order: str) -> str:
    return f"""SELECT {key}, rn <= floor(n * 0.75) AS is_train FROM (SELECT {key}, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM purchases WHERE {key} IS NOT NULL))"""


@query(_split_sql("match_id", "md5('0:' || match_id::varchar), match_id"))
def split_by_match(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_by_key(table(spark, folder, "purchases"), "match_id")


@query(_split_sql("account_id", "md5('0:' || account_id::varchar), account_id"))
def split_by_account(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_by_key(table(spark, folder, "purchases"), "account_id")


@query(_split_sql("match_id", "match_id"))
def split_by_time(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_by_time(table(spark, folder, "purchases"), "match_id")


@query(
    with_("buys")
    + """,
halves AS (SELECT match_id % 2 AS half, item_id, count(*) AS b FROM (SELECT DISTINCT match_id, player_slot, item_id FROM buys) GROUP BY 1, 2),
sizes AS (SELECT match_id % 2 AS half, count(*) AS n FROM (SELECT DISTINCT match_id, player_slot FROM buys) GROUP BY 1),
p AS (SELECT h.half, item_id, b / n AS share FROM halves h JOIN sizes s ON h.half = s.half)
SELECT count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(a.share, b.share) END, 6) AS r FROM p a JOIN p b ON a.item_id = b.item_id AND a.half = 0 AND b.half = 1"""
)
def prevalence_replication(spark: SparkSession, folder: str) -> DataFrame:
    told = prevalence(adapters.buys(spark, folder).withColumn("half", F.col("match_id") % 2), ["half"])
    return splitting.replication(told.where("half = 0"), told.where("half = 1"), ["item_id"], "share").select("n", F.round("r", 6).alias("r"))


@query(
    with_("points")
    + """
SELECT match_id, player_slot, """
    + ", ".join(f"coalesce(max(CASE WHEN game_time_s <= 480 AND signature_slot = {s} THEN level END), 0)::int AS lvl_{s}" for s in (1, 2, 3, 4))
    + """, coalesce(arg_min(signature_slot, (game_time_s, step)) FILTER (game_time_s <= 480 AND signature_slot > 0), 0)::int AS first_slot FROM points GROUP BY match_id, player_slot"""
)
def ability_levels(spark: SparkSession, folder: str) -> DataFrame:
    return points.levels_at(adapters.points(spark, folder), SEAT, 480)


@query(
    with_("points")
    + """,
got AS (SELECT match_id, player_slot, signature_slot, min((game_time_s, step)) AS began FROM points WHERE level >= 1 AND signature_slot > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id, player_slot ORDER BY began, signature_slot) AS nth FROM got)
SELECT p.match_id, p.player_slot, """
    + ", ".join(f"coalesce(max(CASE WHEN r.signature_slot = {s} THEN nth END), 0)::int AS order_{s}" for s in (1, 2, 3, 4))
    + """ FROM (SELECT DISTINCT match_id, player_slot FROM points) p LEFT JOIN r ON p.match_id = r.match_id AND p.player_slot = r.player_slot GROUP BY p.match_id, p.player_slot"""
)
def slot_order(spark: SparkSession, folder: str) -> DataFrame:
    return points.slot_order(adapters.points(spark, folder), SEAT)


POINT_COLUMNS = [f"pt_{s}_l{L}" for s in (1, 2, 3, 4) for L in (2, 3, 4)]
POINT_ORDER = """numbered AS (SELECT *, row_number() OVER (PARTITION BY match_id, player_slot ORDER BY game_time_s, step) - 1 AS spent FROM points),
ordered AS (SELECT match_id, player_slot, hero_id, """ + ", ".join(f"coalesce(min(CASE WHEN signature_slot = {s} AND level >= {L} THEN spent END) / count(*), 1.0::double) AS pt_{s}_l{L}" for s in (1, 2, 3, 4) for L in (2, 3, 4)) + " FROM numbered GROUP BY match_id, player_slot, hero_id)"


def _ordered(spark: SparkSession, folder: str) -> DataFrame:
    return points.point_order(adapters.points(spark, folder), [*SEAT, "hero_id"])


@query(with_("points") + ",\n" + POINT_ORDER + "\nSELECT match_id, player_slot, hero_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in POINT_COLUMNS) + " FROM ordered")
def point_order(spark: SparkSession, folder: str) -> DataFrame:
    return _ordered(spark, folder).select(*SEAT, "hero_id", *(F.round(c, 6).alias(c) for c in POINT_COLUMNS))


@query(with_("points") + ",\n" + POINT_ORDER + "\nSELECT match_id, player_slot, hero_id, " + ", ".join(f"round({c} - avg({c}) OVER (PARTITION BY hero_id), 9) AS {c}" for c in POINT_COLUMNS) + " FROM ordered")
def residual_mean(spark: SparkSession, folder: str) -> DataFrame:
    return points.less_mean(_ordered(spark, folder), ["hero_id"], POINT_COLUMNS).select(*SEAT, "hero_id", *(F.round(c, 9).alias(c) for c in POINT_COLUMNS))


@query(
    with_("points")
    + ",\n"
    + POINT_ORDER
    + """
SELECT match_id, player_slot, hero_id, round((rank() OVER (PARTITION BY hero_id ORDER BY pt_1_l2) + (count(*) OVER (PARTITION BY hero_id, pt_1_l2) - 1) / 2.0) / count(*) OVER (PARTITION BY hero_id) - 0.5, 6)::double AS pt_1_l2 FROM ordered"""
)
def residual_rank(spark: SparkSession, folder: str) -> DataFrame:
    return points.centred_rank(_ordered(spark, folder), ["hero_id"], "pt_1_l2").select(*SEAT, "hero_id", F.round("pt_1_l2", 6).alias("pt_1_l2"))


@query(with_("points") + "\nSELECT match_id, player_slot, coalesce(arg_min(signature_slot, (game_time_s, step)) FILTER (level >= 4 AND signature_slot > 0), 0)::int AS first_maxed FROM points GROUP BY match_id, player_slot")
def first_maxed(spark: SparkSession, folder: str) -> DataFrame:
    return points.first_maxed(adapters.points(spark, folder), SEAT)


@query(
    with_("imbues", "points")
    + """
SELECT i.signature_slot, i.imbue_group, level_then, count(*) AS n FROM (
  SELECT i.match_id, i.player_slot, i.item_id, i.game_time_s, i.signature_slot, i.imbue_group, coalesce(max(p.level), 0)::int AS level_then
  FROM (SELECT DISTINCT * FROM imbues) i LEFT JOIN points p ON i.match_id = p.match_id AND i.player_slot = p.player_slot AND i.signature_slot = p.signature_slot AND p.game_time_s <= i.game_time_s
  GROUP BY ALL) i GROUP BY 1, 2, 3"""
)
def level_at_imbue(spark: SparkSession, folder: str) -> DataFrame:
    flat = adapters.pulls(spark, folder, "item")
    rows = stored(adapters.imbues(spark, folder, flat)[0].distinct(), "imbues")
    return points.level_at(rows, adapters.points(spark, folder, flat), SEAT).groupBy("signature_slot", "imbue_group", "level_then").agg(F.count(F.lit(1)).alias("n"))


@query(
    with_("points")
    + """,
w AS (SELECT hero_id, row_number() OVER (PARTITION BY match_id, player_slot ORDER BY game_time_s, step) - 1 AS step, game_time_s AS v, coalesce(exp(-power((average_badge - 80.0::double) / 25.0::double, 2)), 1.0::double) AS w FROM points WHERE signature_slot > 0),
s AS (SELECT hero_id, step, v, sum(round(w * 1000000)::bigint) AS w FROM w GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY hero_id, step ORDER BY v) AS upto, sum(w) OVER (PARTITION BY hero_id, step) AS total FROM s)
SELECT hero_id, step::int AS step, min(v) AS median FROM c WHERE total > 0 AND upto >= total / 2.0 GROUP BY hero_id, step"""
)
def point_timings(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted median time of each point of a hero, in whole millionths of weight so that sums are exact."""
    rows = points.as_sequence(adapters.points(spark, folder), SEAT)
    w = F.round(F.coalesce(F.exp(-F.pow((F.col("average_badge") - 80.0) / 25.0, 2)), F.lit(1.0)) * 1_000_000).cast("long")
    return points.weighted_median(rows.withColumn("w", w), ["hero_id", "step"], "buy_time_s", "w")


ECONOMY = """priced AS (SELECT b.*, i.cost, i.tier, buy_time_s - lag(buy_time_s) OVER w AS gap, i.tier - lag(i.tier) OVER w AS rise FROM buys b LEFT JOIN items i ON b.item_id = i.id WINDOW w AS (PARTITION BY match_id, player_slot ORDER BY step)),
owned AS (SELECT *, median(gap) OVER (PARTITION BY match_id, player_slot) AS own FROM priced)"""


@query(
    with_("buys")
    + ",\n"
    + ECONOMY
    + """
SELECT match_id, player_slot, coalesce(sum(cost), 0)::bigint AS cost_sum, round(avg(cost), 6) AS cost_mean, max(cost) AS cost_max, round(coalesce(regr_slope(cost::double, step::double), 0), 6) AS cost_slope,
  round(avg(tier), 6) AS tier_mean, max(tier) AS tier_max, sum(CASE WHEN rise > 0 THEN 1 ELSE 0 END)::bigint AS tier_rises, coalesce(max(own), 0) AS median_gap,
  sum(CASE WHEN gap > 1.5 * own THEN 1 ELSE 0 END)::bigint AS saved_up, round(coalesce(sum(CASE WHEN gap > 1.5 * own THEN 1 ELSE 0 END) / nullif(count(gap), 0), 0), 6)::double AS saved_up_share
FROM owned GROUP BY match_id, player_slot"""
)
def economics(spark: SparkSession, folder: str) -> DataFrame:
    told = economy.economics(adapters.buys(spark, folder), adapters.items(spark, folder), SEAT)
    rounded = ("cost_mean", "cost_slope", "tier_mean", "saved_up_share")
    return told.select(*(F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in told.columns))


@query(
    with_("buys")
    + """
SELECT match_id, player_slot, visit::bigint AS visit, count(*) AS n, min(buy_time_s) AS from_s, max(buy_time_s) AS to_s FROM (
  SELECT *, sum(new) OVER (PARTITION BY match_id, player_slot ORDER BY step) AS visit FROM (
    SELECT *, CASE WHEN buy_time_s - lag(buy_time_s) OVER (PARTITION BY match_id, player_slot ORDER BY step) <= 5 THEN 0 ELSE 1 END AS new FROM buys)) GROUP BY match_id, player_slot, visit"""
)
def shop_visits(spark: SparkSession, folder: str) -> DataFrame:
    return economy.visits(adapters.buys(spark, folder), SEAT)


#: Bytes of the files that a batch of the drained stream reads.
BATCH = 1 << 30


@query("SELECT epoch(date_trunc('hour', pulled_at))::bigint AS since, hero_id, count(*) AS n FROM purchases WHERE pulled_at IS NOT NULL GROUP BY ALL")
def stream_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases by hero and hour of their pull, counted as a stream that reads all there is."""
    path = f"{folder}/purchases.parquet"
    # as a pattern, the path may be a file or a folder of files
    rows = streams.read_stream(spark, f"{folder}/purchases.parque[t]", spark.read.parquet(path).schema, size=BATCH)
    told = streams.counts(rows.withColumn("pulled_at", F.col("pulled_at").cast("timestamp")), "pulled_at", ["hero_id"])
    return streams.drained(told).select(F.unix_timestamp("since").alias("since"), "hero_id", "n")
