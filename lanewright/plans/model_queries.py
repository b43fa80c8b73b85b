"""Queries on the next-item model, its evaluation, counters, imbues and groups, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewright.operators import backoff, clusters, counters, evaluation, families, imbues, splitting
from lanewright.plans import adapters
from lanewright.plans.adapters import SEAT, with_
from lanewright.runtime import stored
from lanewright.sources.tables import table

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


PREVALENCE = """seats AS (SELECT DISTINCT hero_id, match_id, player_slot FROM buys), sizes AS (SELECT hero_id, count(*) AS n_players FROM seats GROUP BY hero_id),
prevalence AS (SELECT b.hero_id, item_id, b.buyers, b.buyers / n_players AS share, n_players FROM (SELECT hero_id, item_id, count(*) AS buyers FROM (SELECT DISTINCT hero_id, match_id, player_slot, item_id FROM buys) GROUP BY ALL) b JOIN sizes s ON b.hero_id = s.hero_id)"""


@query(with_("buys") + ",\n" + PREVALENCE + "\nSELECT hero_id, item_id, buyers, round(share, 9) AS share, n_players FROM prevalence")
def item_prevalence(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.prevalence(adapters.buys(spark, folder), ["hero_id"]).withColumn("share", F.round("share", 9))


@query(with_("buys") + ",\n" + PREVALENCE + "\nSELECT hero_id, item_id, buyers, round(share, 9) AS share, place::int AS place FROM (SELECT *, row_number() OVER (PARTITION BY hero_id ORDER BY buyers DESC, item_id) AS place FROM prevalence) WHERE place <= 5")
def top_items_per_hero(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.top_items(adapters.buys(spark, folder), ["hero_id"]).select("hero_id", "item_id", "buyers", F.round("share", 9).alias("share"), "place")


@query(with_("buys") + ",\n" + PREVALENCE + "\nSELECT hero_id, item_id, round(share, 9) AS share, n_players >= 100 AS conclusive FROM prevalence WHERE share >= 0.3")
def staple_items(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.staples(adapters.buys(spark, folder), ["hero_id"], 0.3, 100).withColumn("share", F.round("share", 9))


@query(
    with_("buys")
    + ",\n"
    + PREVALENCE
    + """,
staple AS (SELECT hero_id, item_id, n_players >= 100 AS conclusive FROM prevalence WHERE share >= 0.3),
build AS (SELECT hero_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY hero_id ORDER BY median_step, item_id) AS place FROM (SELECT hero_id, item_id, median(step) AS median_step FROM buys GROUP BY ALL)) WHERE place <= 40)
SELECT s.hero_id, count(*) AS n_staples, sum((b.item_id IS NULL)::int)::bigint AS n_missing, bool_and(conclusive) AND sum((b.item_id IS NULL)::int) = 0 AS passed
FROM staple s LEFT JOIN build b ON s.hero_id = b.hero_id AND s.item_id = b.item_id GROUP BY s.hero_id"""
)
def prevalence_gate(spark: SparkSession, folder: str) -> DataFrame:
    bought = adapters.buys(spark, folder)
    place = F.row_number().over(Window.partitionBy("hero_id").orderBy("median_step", "item_id"))
    build = evaluation.median_order(bought, ["hero_id"]).withColumn("place", place).where("place <= 40")
    return evaluation.gate(build, evaluation.staples(bought, ["hero_id"], 0.3, 100), ["hero_id"])


@query(
    with_("buys")
    + ",\n"
    + PREVALENCE
    + """
SELECT p.hero_id, p.item_id, p.buyers, round(share, 9) AS share, p.n_players, median_place FROM prevalence p JOIN (
  SELECT hero_id, item_id, round_even(median(s) + 1, 0)::int AS median_place FROM (SELECT hero_id, match_id, player_slot, item_id, min(step) AS s FROM buys GROUP BY ALL) GROUP BY hero_id, item_id) m ON p.hero_id = m.hero_id AND p.item_id = m.item_id"""
)
def item_uptake(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.uptake(adapters.buys(spark, folder), ["hero_id"]).select("hero_id", "item_id", "buyers", F.round("share", 9).alias("share"), "n_players", "median_place")


@query(
    with_("labels")
    + """,
lab AS (SELECT b.*, archetype_id FROM buys b JOIN labels l USING (match_id, player_slot)),
cell AS (SELECT hero_id, archetype_id, item_id, count(*) AS buyers FROM (SELECT DISTINCT hero_id, archetype_id, match_id, player_slot, item_id FROM lab) GROUP BY ALL),
size AS (SELECT hero_id, archetype_id, count(*) AS n FROM (SELECT DISTINCT hero_id, archetype_id, match_id, player_slot FROM lab) GROUP BY ALL),
r AS (SELECT c.*, n, sum(buyers) OVER (PARTITION BY hero_id, item_id) AS b_all, (SELECT sum(n) FROM size t WHERE t.hero_id = c.hero_id) AS n_all FROM cell c JOIN size s USING (hero_id, archetype_id)),
g AS (SELECT *, round(buyers / n - coalesce((b_all - buyers) / nullif(n_all - n, 0), 0), 9) AS gap FROM r)
SELECT hero_id, archetype_id, 'common' AS kind, place::int AS place, item_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY hero_id, archetype_id ORDER BY buyers DESC, item_id) AS place FROM g) WHERE place <= 6
UNION ALL SELECT hero_id, archetype_id, 'apart', place::int, item_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY hero_id, archetype_id ORDER BY gap DESC, item_id) AS place FROM g) WHERE place <= 6"""
)
def item_columns(spark: SparkSession, folder: str) -> DataFrame:
    bought = adapters.buys(spark, folder)
    return evaluation.item_columns(bought.join(adapters.labels(bought), SEAT), ["hero_id", "archetype_id"], ["hero_id"])


@query(
    with_("buys")
    + ",\n"
    + PREVALENCE
    + """,
x AS (SELECT hero_id, item_id, row_number() OVER (PARTITION BY hero_id ORDER BY buyers DESC, item_id) AS place FROM prevalence),
y AS (SELECT hero_id, item_id, row_number() OVER (PARTITION BY hero_id ORDER BY m, item_id) AS place FROM (SELECT hero_id, item_id, median(step) AS m FROM buys GROUP BY ALL)),
b AS (SELECT x.hero_id, x.item_id, x.place AS a, y.place AS b FROM x JOIN y ON x.hero_id = y.hero_id AND x.item_id = y.item_id),
tau AS (SELECT p.hero_id, sum(sign(q.b - p.b)) / count(*) AS tau FROM b p JOIN b q ON p.hero_id = q.hero_id AND p.a < q.a GROUP BY p.hero_id)
SELECT h.hero_id, h.n_shared, round(tau, 6) AS tau, round(j6, 6) AS jaccard_6, round(j12, 6) AS jaccard_12 FROM (SELECT hero_id, count(*) AS n_shared FROM b GROUP BY hero_id) h LEFT JOIN tau ON h.hero_id = tau.hero_id
LEFT JOIN (SELECT hero_id, c / (2 * k - c) AS j6 FROM (SELECT hero_id, sum((a <= 6 AND b <= 6)::int) AS c, least(6, count(*)) AS k FROM b GROUP BY hero_id)) j6 ON j6.hero_id = h.hero_id
LEFT JOIN (SELECT hero_id, c / (2 * k - c) AS j12 FROM (SELECT hero_id, sum((a <= 12 AND b <= 12)::int) AS c, least(12, count(*)) AS k FROM b GROUP BY hero_id)) j12 ON j12.hero_id = h.hero_id"""
)
def order_agreement(spark: SparkSession, folder: str) -> DataFrame:
    bought = adapters.buys(spark, folder)
    by = lambda *o: F.row_number().over(Window.partitionBy("hero_id").orderBy(*o))
    popular = evaluation.prevalence(bought, ["hero_id"]).withColumn("place", by(F.desc("buyers"), "item_id"))
    early = evaluation.median_order(bought, ["hero_id"]).withColumn("place", by("median_step", "item_id"))
    told = evaluation.order_agreement(popular, early, ["hero_id"])
    return told.select("hero_id", "n_shared", *(F.round(c, 6).alias(c) for c in ("tau", "jaccard_6", "jaccard_12")))


@query(
    with_("buys")
    + ",\n"
    + PREVALENCE
    + """,
build AS (SELECT hero_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY hero_id ORDER BY buyers DESC, item_id) AS place FROM prevalence) WHERE place <= 12),
b AS (SELECT hero_id, list(item_id) AS build FROM build GROUP BY hero_id),
f AS (SELECT hero_id, list(DISTINCT item_id) AS own, row_number() OVER (PARTITION BY hero_id ORDER BY md5(concat(match_id, '/', player_slot)), match_id, player_slot) AS r, count(*) OVER (PARTITION BY hero_id) AS n
  FROM buys WHERE step < 12 GROUP BY hero_id, match_id, player_slot HAVING count(*) = 12),
j AS (SELECT f.hero_id, f.n, len(list_intersect(build, f.own)) / len(list_distinct(list_concat(build, f.own))) AS a, CASE WHEN f.n > 1 THEN len(list_intersect(f.own, o.own)) / len(list_distinct(list_concat(f.own, o.own))) END AS c
  FROM f JOIN f o ON f.hero_id = o.hero_id AND o.r = f.r % f.n + 1 JOIN b ON f.hero_id = b.hero_id)
SELECT hero_id, count(*) AS n_players, round(avg(a), 6) AS jaccard, round(avg(c), 6) AS ceiling, round(avg(a) / avg(c), 6) AS ratio FROM j GROUP BY hero_id"""
)
def build_membership(spark: SparkSession, folder: str) -> DataFrame:
    """How much builds of the commonest items overlap with players, and players with each other."""
    bought = stored(adapters.buys(spark, folder), "buys")
    told = evaluation.membership(evaluation.top_items(bought, ["hero_id"], 12), bought, ["hero_id"])
    return told.select("hero_id", "n_players", *(F.round(c, 6).alias(c) for c in ("jaccard", "ceiling", "ratio")))


WEIGHTS = "weights AS (SELECT *, raw / avg(raw) OVER () AS weight FROM (SELECT *, coalesce(exp(-power((average_badge - 80.0::double) / 25.0::double, 2)), 1.0::double) AS raw FROM buys))"


@query(with_("buys") + ",\n" + WEIGHTS + "\nSELECT match_id, player_slot, buy_index, round(weight, 6) AS weight FROM weights")
def row_weights(spark: SparkSession, folder: str) -> DataFrame:
    return backoff.row_weights(adapters.buys(spark, folder), SEAT, backoff.TARGET).select(*SEAT, "buy_index", F.round("weight", 6).alias("weight"))


PREPARED = """prepared AS (SELECT b.*, lag(item_id, 1, -1) OVER w AS prev_one, lag(item_id, 2, -1) OVER w AS prev_two, step::int AS n_owned,
  (buy_time_s >= 300)::int + (buy_time_s >= 600)::int + (buy_time_s >= 900)::int + (buy_time_s >= 1200)::int + (buy_time_s >= 1800)::int AS time_bucket, archetype_id
  FROM buys b JOIN labels l USING (match_id, player_slot) WINDOW w AS (PARTITION BY match_id, player_slot ORDER BY step))"""
LEVELS = "levels AS (" + " UNION ALL ".join(f"SELECT {k} AS level, concat_ws('|', {', '.join(keys)}) AS ctx, item_id, count(*)::double AS w, count(*) AS n FROM prepared GROUP BY 2, 3" for k, keys in enumerate(backoff.LEVELS)) + ")"


@query(with_("labels") + ",\n" + PREPARED + "\nSELECT match_id, player_slot, buy_index, prev_one, prev_two, n_owned, time_bucket, archetype_id FROM prepared")
def prepared_lags(spark: SparkSession, folder: str) -> DataFrame:
    bought = adapters.buys(spark, folder)
    return backoff.prepared(bought, adapters.labels(bought), SEAT).select(*SEAT, "buy_index", "prev_one", "prev_two", "n_owned", "time_bucket", "archetype_id")


def _levels(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    bought = stored(adapters.buys(spark, folder), "buys")
    labels = adapters.labels(bought)
    return backoff.levels(backoff.prepared(bought, labels, SEAT)), bought, labels


@query(with_("labels") + ",\n" + PREPARED + ",\n" + LEVELS + "\nSELECT * FROM levels")
def backoff_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder)[0]


@query(with_("labels") + "\nSELECT hero_id, archetype_id, round(count(*) / sum(count(*)) OVER (PARTITION BY hero_id), 9) AS share FROM (SELECT DISTINCT hero_id, match_id, player_slot, archetype_id FROM buys JOIN labels USING (match_id, player_slot)) GROUP BY hero_id, archetype_id")
def archetype_shares(spark: SparkSession, folder: str) -> DataFrame:
    bought = adapters.buys(spark, folder)
    return backoff.archetype_shares(bought, adapters.labels(bought), SEAT).withColumn("share", F.round("share", 9))


STATES = """states AS (SELECT match_id || '/' || player_slot AS state_id, hero_id, archetype_id, prev_one AS prev_two, item_id AS prev_one, step::int + 1 AS n_owned, time_bucket FROM prepared
  QUALIFY step = max(step) OVER (PARTITION BY match_id, player_slot)),
owned AS (SELECT DISTINCT match_id || '/' || player_slot AS state_id, item_id FROM buys),
total AS (SELECT level, ctx, sum(w) AS total FROM levels GROUP BY level, ctx),
asked AS (""" + " UNION ALL ".join(f"SELECT state_id, {k} AS level, concat_ws('|', {', '.join(keys)}) AS ctx FROM states" for k, keys in enumerate(backoff.LEVELS)) + """),
lam AS (SELECT state_id, """ + ", ".join(f"coalesce(max(CASE WHEN a.level = {k} THEN total / (total + 20) END), 0) AS l{k}" for k in range(6)) + """ FROM asked a JOIN total t ON a.level = t.level AND a.ctx = t.ctx GROUP BY state_id),
part AS (SELECT a.state_id, v.item_id, a.level, v.n, v.w / t.total * (CASE a.level """ + " ".join(f"WHEN {k} THEN l{k}" + "".join(f" * (1 - l{j})" for j in range(k)) for k in range(6)) + """ END) AS part
  FROM asked a JOIN total t ON a.level = t.level AND a.ctx = t.ctx JOIN lam USING (state_id) JOIN levels v ON a.level = v.level AND a.ctx = v.ctx),
mixed AS (SELECT state_id, item_id, sum(part) AS p FROM part p WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.state_id = p.state_id AND o.item_id = p.item_id) GROUP BY state_id, item_id),
chance AS (SELECT state_id, item_id, p / sum(p) OVER (PARTITION BY state_id) AS p FROM mixed)"""
MODEL = with_("labels") + ",\n" + PREPARED + ",\n" + LEVELS + ",\n" + STATES


def _seat_id() -> Column:
    return F.concat_ws("/", *SEAT).alias("state_id")


@query(MODEL + "\nSELECT state_id, item_id, round(p, 6) AS p FROM chance")
def backoff_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Chances of every item that each seat does not own, after its last purchase."""
    level_table, bought, labels = _levels(spark, folder)
    states = stored(backoff.states_now(bought, labels, SEAT), "states")
    return backoff.distribution(states, stored(level_table, "levels"), bought.select(_seat_id(), "item_id").distinct()).withColumn("p", F.round("p", 6))


def chances_sql(states: str, levels: str, name: str) -> str:
    """``name`` (key columns, item_id, p): the chance of every item in every state, its parts rounded as the operator rounds them."""
    keys = ", ".join(backoff.KEYS)
    joined = " AND ".join(f"a.{k} = b.{k}" for k in backoff.KEYS)
    coefficient = lambda lo, hi: "CASE a.level " + " ".join(f"WHEN {k} THEN " + "".join(f"(1 - l{j}) * " for j in range(lo, k)) + f"l{k}" for k in range(lo, hi)) + " END"
    half = lambda lo, hi: f"SELECT {keys}, item_id, round(sum({coefficient(lo, hi)} / total * w), 12) AS p FROM {name}_seen a WHERE level >= {lo} AND level < {hi} GROUP BY {keys}, item_id"
    return f"""{name}_total AS (SELECT level, ctx, sum(w) AS total FROM {levels} GROUP BY level, ctx),
{name}_asked AS ({" UNION ALL ".join(f"SELECT {keys}, {k} AS level, concat_ws('|', {', '.join(own)}) AS ctx FROM {states}" for k, own in enumerate(backoff.LEVELS))}),
{name}_lam AS (SELECT {keys}, {", ".join(f"coalesce(max(CASE WHEN a.level = {k} THEN total / (total + 20) END), 0) AS l{k}" for k in range(6))} FROM {name}_asked a JOIN {name}_total t ON a.level = t.level AND a.ctx = t.ctx GROUP BY {keys}),
{name}_seen AS (SELECT a.*, b.* EXCLUDE ({keys}), t.total, v.item_id, v.w FROM {name}_asked a JOIN {name}_lam b ON {joined} JOIN {name}_total t ON a.level = t.level AND a.ctx = t.ctx JOIN {levels} v ON a.level = v.level AND a.ctx = v.ctx),
{name}_fine AS ({half(0, 2)}), {name}_coarse AS ({half(2, 6)}),
{name} AS (SELECT {keys}, item_id, coalesce(f.p, 0) + (1 - l0) * (1 - l1) * coalesce(c.p, 0) AS p FROM {name}_fine f FULL JOIN {name}_coarse c USING ({keys}, item_id) JOIN {name}_lam USING ({keys}))"""


@query(
    MODEL + ",\n" + chances_sql("(SELECT DISTINCT " + ", ".join(backoff.KEYS) + " FROM states)", "levels", "likely")
    + ",\nopen_ AS (SELECT s.state_id, l.item_id, l.p FROM states s JOIN likely l ON " + " AND ".join(f"s.{k} = l.{k}" for k in backoff.KEYS)
    + """ WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.state_id = s.state_id AND o.item_id = l.item_id))
SELECT state_id, place::int AS place, item_id, round(p / whole, 6) AS p FROM (SELECT *, sum(p) OVER (PARTITION BY state_id) AS whole, row_number() OVER (PARTITION BY state_id ORDER BY p DESC, item_id) AS place FROM open_) WHERE place <= 3"""
)
def next_item_top3(spark: SparkSession, folder: str) -> DataFrame:
    """The three likeliest next items of every seat, after its last purchase."""
    level_table, bought, labels = _levels(spark, folder)
    owned = bought.groupBy(*SEAT).agg(F.collect_set("item_id").alias("owned"))
    states = stored(backoff.states_now(bought, labels, SEAT).join(owned, SEAT), "states")
    told = backoff.ranked(states, backoff.state_tables(states, stored(level_table, "levels")))
    rows = told.select("state_id", "left", F.posexplode(F.slice("best", 1, 3)).alias("at", "b"))
    return rows.select("state_id", (F.col("at") + 1).alias("place"), F.col("b.item_id").alias("item_id"), F.round(F.try_divide(-F.col("b.down"), F.col("left")), 6).alias("p"))


@query(
    MODEL
    + """
SELECT state_id, item_id, round(p, 6) AS p, level, n FROM (SELECT state_id, item_id, sum(part) AS p, arg_max(level, (round(part, 9), -level)) AS level, arg_max(n, (round(part, 9), -level)) AS n FROM part GROUP BY state_id, item_id)"""
)
def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The level that says most about each item, for every seat after its last purchase."""
    level_table, bought, labels = _levels(spark, folder)
    states = stored(backoff.states_now(bought, labels, SEAT).select("state_id", *backoff.KEYS), "states")
    told = backoff.evidence(backoff.contributions(states, stored(level_table, "levels")), 9)
    return told.select("state_id", "item_id", F.round("p", 6).alias("p"), "level", "n")


#: How purchases are held out: by match, by account, or the latest matches.  An account that is not known trains.
SPLITS = {"match": ("match_id", splitting.split_by_key), "account": ("account_id", splitting.split_by_key), "time": ("match_id", splitting.split_by_time)}
BASE = {"popularity": ("hero_id",), "positional": ("hero_id", "step"), "bigram": ("hero_id", "prev_one")}
SPLIT_SQL = {
    "match": ("match_id", "md5('0:' || match_id::varchar), match_id"),
    "account": ("account_id", "md5('0:' || account_id::varchar), account_id"),
    "time": ("match_id", "match_id"),
}


def held_out_sql(split: str) -> str:
    """``train_<split>``, ``test_<split>``: prepared purchases by the side of their key."""
    key, order = SPLIT_SQL[split]
    return f"""side_{split} AS (SELECT {key}, rn <= floor(n * 0.75) AS is_train FROM (SELECT {key}, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM buys WHERE {key} IS NOT NULL))),
sided_{split} AS (SELECT p.*, coalesce(is_train, true) AS is_train FROM prepared p LEFT JOIN side_{split} s ON p.{key} = s.{key}),
train_{split} AS (SELECT * FROM sided_{split} WHERE is_train),
test_{split} AS (SELECT t.*, o.since FROM sided_{split} t JOIN own o ON t.match_id = o.match_id AND t.player_slot = o.player_slot AND t.item_id = o.item_id WHERE NOT is_train)"""


OWN = "own AS (SELECT match_id, player_slot, item_id, min(step) AS since FROM buys GROUP BY ALL)"


def _decisions(spark: SparkSession, folder: str) -> DataFrame:
    bought = stored(adapters.buys(spark, folder), "buys")
    return stored(backoff.before_each(bought, adapters.labels(bought), SEAT), "decisions")


def _sided(rows: DataFrame, split: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of a split."""
    key, cut = SPLITS[split]
    sided = rows.join(cut(rows, key), key, "left").withColumn("is_train", F.coalesce("is_train", F.lit(True)))
    return sided.where("is_train"), sided.where("not is_train")


def _scored(hits: DataFrame, split: str, model: str) -> DataFrame:
    return evaluation.accuracy(hits).select(F.lit(split).alias("split"), F.lit(model).alias("model"), "n", F.round("top_1", 9).alias("top_1"), F.round("top_3", 9).alias("top_3"))


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _lists_sql(split: str, name: str) -> str:
    keys, train = ", ".join(BASE[name]), f"train_{split}"
    source = f"(SELECT DISTINCT hero_id, match_id, player_slot, item_id FROM {train})" if name == "popularity" else f"(SELECT * FROM {train} WHERE prev_one <> -1)" if name == "bigram" else train
    return f"{name}_{split} AS (SELECT {keys}, item_id, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, item_id) AS place FROM {source} GROUP BY {keys}, item_id)"


def _accuracy_sql(split: str, name: str) -> str:
    on = " AND ".join(f"d.{c} = l.{c}" for c in BASE[name])
    above = " AND ".join(f"m.{c} = d.{c}" for c in BASE[name])
    return f"""SELECT '{split}' AS split, '{name}' AS model, count(*) AS n, round(avg((coalesce(hit, 99) <= 1)::int), 9) AS top_1, round(avg((coalesce(hit, 99) <= 3)::int), 9) AS top_3 FROM (
  SELECT CASE WHEN d.since < d.step THEN NULL ELSE l.place - (SELECT count(*) FROM own o JOIN {name}_{split} m ON m.item_id = o.item_id AND {above} WHERE o.match_id = d.match_id AND o.player_slot = d.player_slot AND o.since < d.step AND m.place < l.place) END AS hit
  FROM test_{split} d LEFT JOIN {name}_{split} l ON d.item_id = l.item_id AND {on})"""


@query(
    with_("labels") + ",\n" + PREPARED + ",\n" + OWN + ",\n"
    + ",\n".join(held_out_sql(split) + ",\n" + ",\n".join(_lists_sql(split, name) for name in BASE) for split in SPLITS)
    + "\n" + "\nUNION ALL ".join(_accuracy_sql(split, name) for split in SPLITS for name in BASE)
)
def baseline_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Three baselines on every held-out decision, by three splits."""
    rows = _decisions(spark, folder)
    out = []
    for split in SPLITS:
        train, test = _sided(rows, split)
        for name, context in BASE.items():
            lists = evaluation.popularity_lists(train) if name == "popularity" else evaluation.ranked_lists(train.where("prev_one <> -1") if name == "bigram" else train, list(context))
            out.append(_scored(evaluation.hit_places(test, lists, list(context)), split, name))
    return _together(out)


def _model_sql(split: str) -> str:
    keys = ", ".join(backoff.KEYS)
    return f"""{held_out_sql(split)},
{LEVELS.replace("levels AS (", f"levels_{split} AS (", 1).replace("FROM prepared", f"FROM train_{split}")},
{chances_sql(f"(SELECT DISTINCT {keys} FROM test_{split})", f"levels_{split}", f"likely_{split}")},
hit_{split} AS (SELECT d.match_id, d.player_slot, d.step, CASE WHEN any_value(d.since) < d.step THEN NULL WHEN max(a.p) IS NOT NULL THEN 1 + count(l.item_id) FILTER (l.p > a.p OR (l.p = a.p AND l.item_id < d.item_id)) END AS hit
  FROM test_{split} d LEFT JOIN likely_{split} a ON {" AND ".join(f"d.{k} = a.{k}" for k in backoff.KEYS)} AND d.item_id = a.item_id LEFT JOIN likely_{split} l ON {" AND ".join(f"d.{k} = l.{k}" for k in backoff.KEYS)}
    AND NOT EXISTS (SELECT 1 FROM own o WHERE o.match_id = d.match_id AND o.player_slot = d.player_slot AND o.item_id = l.item_id AND o.since < d.step) GROUP BY d.match_id, d.player_slot, d.step)"""


@query(
    with_("labels") + ",\n" + PREPARED + ",\n" + OWN + ",\n" + ",\n".join(map(_model_sql, SPLITS)) + "\n"
    + "\nUNION ALL ".join(f"SELECT '{split}' AS split, 'backoff' AS model, count(*) AS n, round(avg((coalesce(hit, 999) <= 1)::int), 9) AS top_1, round(avg((coalesce(hit, 999) <= 3)::int), 9) AS top_3 FROM hit_{split}" for split in SPLITS)
)
def next_item_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """How often the next item is among the model's first guesses, over every held-out decision, by three splits."""
    rows = _decisions(spark, folder)
    out = []
    for split in SPLITS:
        train, test = _sided(rows, split)
        level_table = stored(backoff.levels(train), "levels")
        told = backoff.ranked(test.select(*backoff.KEYS, "owned", "item_id"), backoff.state_tables(test, level_table))
        place = F.array_position(F.transform("best", lambda b: b["item_id"]), F.col("item_id")).cast("int")
        out.append(_scored(told.select(F.nullif(place, F.lit(0)).alias("hit")), split, "backoff"))
    return _together(out)


@query("SELECT count(*) AS n, round(avg((average_badge >= 80)::int), 9) AS share FROM (SELECT DISTINCT match_id, player_slot, average_badge FROM (" + adapters.CTES["buys"][1] + ") WHERE average_badge IS NOT NULL)")
def bracket_share(spark: SparkSession, folder: str) -> DataFrame:
    return backoff.bracket_share(adapters.buys(spark, folder), SEAT, 80).withColumn("share", F.round("share", 9))


@query(
    with_("buys")
    + """,
s AS (SELECT match_id || '/' || player_slot AS state_id, match_id, player_slot, nw_at_buy AS souls FROM buys QUALIFY step = max(step) OVER (PARTITION BY match_id, player_slot))
SELECT state_id, count(*) AS n, sum(coalesce(cost, 0))::bigint AS cost FROM s, items i WHERE coalesce(cost, 0) <= souls AND NOT EXISTS (SELECT 1 FROM buys b WHERE b.match_id = s.match_id AND b.player_slot = s.player_slot AND b.item_id = i.id) GROUP BY state_id"""
)
def candidate_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items that each seat could still buy after its last purchase, counted."""
    bought = adapters.buys(spark, folder)
    states = backoff.states_now(bought, adapters.labels(bought), SEAT).select("state_id", F.col("nw_at_buy").alias("souls"))
    owned = bought.select(_seat_id(), "item_id").distinct()
    return backoff.candidates(states, owned, adapters.items(spark, folder), "souls").groupBy("state_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").cast("long").alias("cost"))


def rosters_sql(source: str = "buys", tag: str = "") -> str:
    return f"""roster{tag} AS (SELECT DISTINCT match_id, player_slot, team, hero_id FROM {source} WHERE team IS NOT NULL),
facing{tag} AS (SELECT DISTINCT a.match_id, a.player_slot, b.hero_id AS enemy_hero_id FROM roster{tag} a JOIN roster{tag} b ON a.match_id = b.match_id AND a.team <> b.team)"""


def lifts_sql(source: str = "buys", tag: str = "", least: int = 100) -> str:
    return f"""{rosters_sql(source, tag)},
have{tag} AS (SELECT DISTINCT match_id, player_slot, item_id FROM {source}), n{tag} AS (SELECT count(*) AS n FROM (SELECT DISTINCT match_id, player_slot FROM {source})),
base{tag} AS (SELECT item_id, count(*) / max(n.n) AS baseline_rate FROM have{tag}, n{tag} n GROUP BY item_id), nf{tag} AS (SELECT enemy_hero_id, count(*) AS n_facing FROM facing{tag} GROUP BY enemy_hero_id HAVING count(*) >= {least}),
lifts{tag} AS (SELECT f.item_id, f.enemy_hero_id, c / n_facing AS facing_rate, baseline_rate, c / n_facing - baseline_rate AS lift, n_facing FROM (SELECT item_id, enemy_hero_id, count(*) AS c FROM facing{tag} JOIN have{tag} USING (match_id, player_slot) GROUP BY ALL) f
  JOIN nf{tag} nf ON f.enemy_hero_id = nf.enemy_hero_id JOIN base{tag} b ON b.item_id = f.item_id WHERE c / n_facing - baseline_rate >= -1)"""


ROSTERS, LIFTS = rosters_sql(), lifts_sql()


@query(with_("buys") + ",\n" + ROSTERS + "\nSELECT * FROM facing")
def enemy_rosters(spark: SparkSession, folder: str) -> DataFrame:
    return counters.enemy_rosters(adapters.buys(spark, folder))


@query(with_("buys") + ",\n" + LIFTS + "\nSELECT item_id, enemy_hero_id, round(facing_rate, 9) AS facing_rate, round(baseline_rate, 9) AS baseline_rate, round(lift, 9) AS lift, n_facing FROM lifts")
def counter_lifts(spark: SparkSession, folder: str) -> DataFrame:
    told = counters.counter_lifts(adapters.buys(spark, folder), 100, -1)
    return told.select("item_id", "enemy_hero_id", *(F.round(c, 9).alias(c) for c in ("facing_rate", "baseline_rate", "lift")), "n_facing")


@query(with_("buys") + ",\n" + LIFTS + "\nSELECT item_id, enemy_hero_id, round(lift, 9) AS lift FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(lift, 9) DESC, enemy_hero_id) AS p FROM lifts) WHERE p = 1")
def best_counters(spark: SparkSession, folder: str) -> DataFrame:
    return counters.best_counters(counters.counter_lifts(adapters.buys(spark, folder), 100, -1)).select("item_id", "enemy_hero_id", F.round("lift", 9).alias("lift"))


def _half_lifts(half: int) -> str:
    return f"half_{half} AS (SELECT * FROM buys WHERE match_id % 2 = {half}),\n" + lifts_sql(f"half_{half}", f"_{half}", 30)


@query(with_("buys") + ",\n" + _half_lifts(0) + ",\n" + _half_lifts(1) + "\nSELECT count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(a.lift, b.lift) END, 6) AS r FROM lifts_0 a JOIN lifts_1 b ON a.item_id = b.item_id AND a.enemy_hero_id = b.enemy_hero_id")
def counter_replication(spark: SparkSession, folder: str) -> DataFrame:
    """Whether counter lifts of even matches say the same as those of odd ones."""
    bought = stored(adapters.buys(spark, folder), "buys")
    return counters.replicates(bought.where("match_id % 2 = 0"), bought.where("match_id % 2 = 1"), 30).withColumn("r", F.round("r", 6))


DIRECTION = """aims AS (SELECT hero_id, item_id, signature_slot, count(*) AS n FROM imbues GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY hero_id, item_id) AS p FROM aims),
who AS (SELECT hero_id, item_id, count(*) AS buyers FROM (SELECT DISTINCT hero_id, item_id, match_id, player_slot FROM imbues) GROUP BY ALL), np AS (SELECT hero_id, count(*) AS np FROM players GROUP BY hero_id),
direction AS (SELECT p.hero_id, p.item_id, sum(n)::bigint AS purchases, max(buyers) AS buyers, max(buyers) / max(np) AS buy_rate, arg_max(signature_slot, (n, -signature_slot)) AS top_slot, max(p) AS top_share, -sum(p * log2(p)) AS entropy
  FROM p JOIN who ON p.hero_id = who.hero_id AND p.item_id = who.item_id JOIN np ON np.hero_id = p.hero_id GROUP BY p.hero_id, p.item_id),
rates AS (SELECT np.hero_id, coalesce(c, 0) / np AS rate FROM np LEFT JOIN (SELECT hero_id, count(*) AS c FROM (SELECT DISTINCT hero_id, match_id, player_slot FROM imbues) GROUP BY hero_id) d ON d.hero_id = np.hero_id)"""


def _imbued(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Imbues and players, stored: the queries read both several times."""
    rows, players = adapters.imbues(spark, folder)
    return stored(rows, "imbues"), stored(players, "players")


@query(with_("imbues", "players") + ",\n" + DIRECTION + "\nSELECT hero_id, item_id, purchases, buyers, round(buy_rate, 9) AS buy_rate, top_slot, round(top_share, 9) AS top_share, round(entropy, 6) AS entropy FROM direction")
def item_direction(spark: SparkSession, folder: str) -> DataFrame:
    told = imbues.item_direction(*_imbued(spark, folder), SEAT)
    return told.select("hero_id", "item_id", "purchases", "buyers", F.round("buy_rate", 9).alias("buy_rate"), "top_slot", F.round("top_share", 9).alias("top_share"), F.round("entropy", 6).alias("entropy"))


@query(with_("imbues", "players") + ",\n" + DIRECTION + "\nSELECT hero_id, round(rate, 9) AS rate FROM rates")
def imbue_rate(spark: SparkSession, folder: str) -> DataFrame:
    return imbues.imbue_rate(*_imbued(spark, folder), SEAT).withColumn("rate", F.round("rate", 9))


@query(with_("imbues", "players") + ",\n" + DIRECTION + "\nSELECT DISTINCT d.hero_id FROM direction d JOIN rates r ON d.hero_id = r.hero_id WHERE purchases >= 2 AND buy_rate >= 0.02 AND entropy >= 0.8 AND rate >= 0.05")
def gated_heroes(spark: SparkSession, folder: str) -> DataFrame:
    rows, players = _imbued(spark, folder)
    return imbues.gated_heroes(imbues.item_direction(rows, players, SEAT), imbues.imbue_rate(rows, players, SEAT), 0.05, min_purchases=2, min_buy_rate=0.02, min_entropy=0.8)


IMBUE_FEATURES = "features AS (SELECT s.hero_id, s.match_id, s.player_slot, " + ", ".join(f"coalesce(sum((imbue_group = '{g}' AND signature_slot = {k})::int) / nullif(sum((imbue_group = '{g}')::int), 0), 0) AS {g}_{k}" for g in ("active", "modifier") for k in (1, 2, 3, 4)) + """, least(count(i.item_id) / 4, 1) AS depth, (count(i.item_id) > 0)::int AS has_imbue
FROM players s LEFT JOIN imbues i ON s.match_id = i.match_id AND s.player_slot = i.player_slot GROUP BY s.hero_id, s.match_id, s.player_slot)"""
SHARES = [f"{g}_{k}" for g in ("active", "modifier") for k in (1, 2, 3, 4)]


@query(with_("imbues", "players") + ",\n" + IMBUE_FEATURES + "\nSELECT match_id, player_slot, " + ", ".join(f"round({c}, 9) AS {c}" for c in SHARES) + ", round(depth, 9)::double AS depth, has_imbue FROM features")
def imbue_features(spark: SparkSession, folder: str) -> DataFrame:
    told = imbues.imbue_features(*_imbued(spark, folder), SEAT)
    return told.select(*SEAT, *(F.round(c, 9).alias(c) for c in [*SHARES, "depth"]), "has_imbue")


@query(with_("imbues", "players") + ",\n" + IMBUE_FEATURES + "\nSELECT match_id, player_slot, " + ", ".join(f"round(CASE WHEN has_imbue = 1 THEN {c} ELSE coalesce(avg({c}) FILTER (has_imbue = 1) OVER (PARTITION BY hero_id), 0) END, 6) AS {c}" for c in SHARES) + " FROM features")
def conditional_imbues(spark: SparkSession, folder: str) -> DataFrame:
    rows, players = _imbued(spark, folder)
    told = imbues.conditional_features(stored(imbues.imbue_features(rows, players, SEAT), "features"), players, SEAT)
    return told.select(*SEAT, *(F.round(c, 6).alias(c) for c in SHARES))


@query(with_("imbues", "players") + "\nSELECT item_id, arg_max(imbued_ability_id, (n, -imbued_ability_id)) AS ability_id, max(n) AS n, round(max(n) / sum(n), 9) AS share FROM (SELECT item_id, imbued_ability_id, count(*) AS n FROM imbues GROUP BY ALL) GROUP BY item_id")
def usual_targets(spark: SparkSession, folder: str) -> DataFrame:
    return imbues.usual_targets(adapters.imbues(spark, folder)[0]).withColumn("share", F.round("share", 9))


#: Fixed values of the example: families by shop tab, and by words of the tooltips.
TAB = {"weapon": "gun", "spirit": "spirit", "vitality": "tank"}
WORDS = {"control": ("slow|silence|range limit", 2), "mobility": ("dash|stamina|movement", 2), "sustain": ("sustain|health|heal", 1), "gun": ("gun|fire rate", 1)}
FAMILIES = ("spirit", "gun", "tank", "control", "mobility", "sustain")


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    shop = adapters.items(spark, folder)
    tab = F.coalesce(*(F.when(F.col("slot_type") == s, f) for s, f in TAB.items()))
    by_tab = shop.select(F.col("id").alias("item_id"), tab.alias("family"), F.lit(2).alias("score")).where("family is not null")
    known = table(spark, folder, "sections").where("item_id is not null and prose is not null")
    return families.family_scores(by_tab, families.text_evidence(known, "item_id", "prose", WORDS).distinct())


SCORES = "evidence AS (SELECT id AS item_id, CASE slot_type " + " ".join(f"WHEN '{s}' THEN '{f}'" for s, f in TAB.items()) + " END AS family, 2 AS score FROM items WHERE slot_type IN ('weapon', 'spirit', 'vitality')" + "".join(f" UNION ALL SELECT DISTINCT item_id, '{f}', {w} FROM sections WHERE item_id IS NOT NULL AND regexp_matches(prose, '(?i){r}')" for f, (r, w) in WORDS.items()) + "), scores AS (SELECT item_id, family, sum(score)::bigint AS score FROM evidence GROUP BY ALL), weights AS (SELECT item_id, family, score / sum(score) OVER (PARTITION BY item_id) AS w FROM scores)"


@query("WITH " + SCORES + "\nSELECT * FROM scores")
def item_families(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder)


@query("WITH " + SCORES + "\nSELECT family, round(ln((SELECT count(*) FROM items) / count(DISTINCT item_id)), 9) AS idf FROM scores GROUP BY family")
def family_idf(spark: SparkSession, folder: str) -> DataFrame:
    return families.rarity(_scores(spark, folder), adapters.items(spark, folder).count()).withColumn("idf", F.round("idf", 9))


FAMILY_SHARES = "spent AS (SELECT hero_id, match_id, player_slot, family, coalesce(cost, 0) * w AS s FROM buys b JOIN items i ON b.item_id = i.id JOIN weights ON weights.item_id = b.item_id), family_shares AS (SELECT hero_id, match_id, player_slot, " + ", ".join(f"sum(CASE WHEN family = '{f}' THEN s ELSE 0 END) / sum(s) AS {f}" for f in FAMILIES) + " FROM spent GROUP BY hero_id, match_id, player_slot HAVING sum(s) > 0)"


def _family_shares(spark: SparkSession, folder: str) -> DataFrame:
    return families.family_shares(adapters.buys(spark, folder), adapters.items(spark, folder), families.family_weights(_scores(spark, folder)), list(FAMILIES), ["hero_id", *SEAT])


@query(with_("buys") + ",\n" + SCORES + ",\n" + FAMILY_SHARES + "\nSELECT hero_id, match_id, player_slot, " + ", ".join(f"round({f}, 12) AS {f}" for f in FAMILIES) + " FROM family_shares")
def family_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _family_shares(spark, folder).select("hero_id", *SEAT, *(F.round(f, 12).alias(f) for f in FAMILIES))


@query(
    with_("buys")
    + "\nSELECT match_id, player_slot, "
    + ", ".join(f"round(coalesce(sum(CASE WHEN slot_type = '{s}' THEN coalesce(cost, 0) ELSE 0 END) / nullif(sum(coalesce(cost, 0)), 0), 0), 6)::double AS {s}" for s in TAB)
    + " FROM buys b JOIN items i ON b.item_id = i.id WHERE slot_type IS NOT NULL GROUP BY match_id, player_slot"
)
def slot_shares(spark: SparkSession, folder: str) -> DataFrame:
    return families.slot_shares(adapters.buys(spark, folder), adapters.items(spark, folder), list(TAB), SEAT).select(*SEAT, *(F.round(s, 6).alias(s) for s in TAB))


#: Fixed values of the example: tags by words of the documents.
TAGS = {"burst": r"\bburst\b|\bblast", "control": r"\bslow|silence|stun", "support": r"support|healers", "gun": r"\bgun\b|weapon", "mobility": r"\bdash\b|stamina|movement", "sustain": r"sustain|refund"}


@query("\nUNION ALL ".join(f"SELECT doc_id, '{t}' AS tag FROM documents WHERE regexp_matches(text, '(?i){r}')" for t, r in TAGS.items()))
def text_tags(spark: SparkSession, folder: str) -> DataFrame:
    return families.tags(table(spark, folder, "documents"), "doc_id", "text", TAGS)


@query("WITH t AS (" + " UNION ALL ".join(f"SELECT source, '{t}' AS tag, doc_id FROM documents WHERE source IS NOT NULL AND regexp_matches(text, '(?i){r}')" for t, r in TAGS.items()) + ") SELECT tag, round(ln((SELECT count(DISTINCT source) FROM documents) / count(DISTINCT source)), 9) AS idf, max(c) AS most FROM (SELECT source, tag, count(*) AS c FROM t GROUP BY ALL) GROUP BY tag")
def tag_idf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    counts = families.tags(docs, "doc_id", "text", TAGS).join(docs.where("source is not null").select("doc_id", "source"), "doc_id").groupBy("source", "tag").agg(F.count(F.lit(1)).alias("c"))
    n = docs.where("source is not null").select("source").distinct().count()
    return families.rarity(counts, n, "source", "tag").join(counts.groupBy("tag").agg(F.max("c").alias("most")), "tag").select("tag", F.round("idf", 9).alias("idf"), "most")


CLUSTERS = """lab AS (SELECT b.*, archetype_id FROM buys b JOIN labels l USING (match_id, player_slot)),
own AS (SELECT hero_id, archetype_id, item_id, count(*) AS c FROM (SELECT DISTINCT hero_id, archetype_id, item_id, match_id, player_slot FROM lab) GROUP BY ALL),
size AS (SELECT hero_id, archetype_id, count(*) AS n FROM (SELECT DISTINCT hero_id, archetype_id, match_id, player_slot FROM lab) GROUP BY ALL),
prev AS (SELECT i.hero_id, s.archetype_id, i.item_id, coalesce(c / n, 0) AS p FROM (SELECT DISTINCT hero_id, item_id FROM own) i JOIN size s ON i.hero_id = s.hero_id LEFT JOIN own o ON o.hero_id = i.hero_id AND o.archetype_id = s.archetype_id AND o.item_id = i.item_id),
gaps AS (SELECT hero_id, a, b, max(g) AS gap, arg_max(item_id, (g, -item_id)) AS item_id FROM (SELECT x.hero_id, x.archetype_id AS a, y.archetype_id AS b, x.item_id, round(abs(x.p - y.p), 9) AS g FROM prev x JOIN prev y ON x.hero_id = y.hero_id AND x.item_id = y.item_id AND x.archetype_id < y.archetype_id) GROUP BY hero_id, a, b)"""


def _prevalences(spark: SparkSession, folder: str) -> DataFrame:
    bought = adapters.buys(spark, folder)
    return clusters.cluster_prevalence(bought, adapters.labels(bought))


@query(with_("labels") + ",\n" + CLUSTERS + "\nSELECT hero_id, archetype_id, item_id, round(p, 9) AS p FROM prev")
def cluster_prevalence(spark: SparkSession, folder: str) -> DataFrame:
    return _prevalences(spark, folder).withColumn("p", F.round("p", 9))


@query(with_("labels") + ",\n" + CLUSTERS + "\nSELECT hero_id, min(gap) AS separation, arg_min(item_id, (gap, a, b)) AS item_id FROM gaps GROUP BY hero_id")
def separation(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.separation(clusters.pair_gaps(_prevalences(spark, folder)))


@query(with_("labels") + ",\n" + CLUSTERS + """
SELECT hero_id, archetype_id, place::int AS place, item_id, lift FROM (SELECT *, row_number() OVER (PARTITION BY hero_id, archetype_id ORDER BY lift DESC, item_id) AS place FROM (
  SELECT *, round(p - coalesce((sum(p) OVER w - p) / nullif(count(p) OVER w - 1, 0), 0), 9) AS lift FROM prev WINDOW w AS (PARTITION BY hero_id, item_id))) WHERE place <= 15""")
def discriminative_items(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.discriminative(_prevalences(spark, folder))


CENTROIDS = "fs AS (SELECT f.*, archetype_id FROM family_shares f JOIN labels USING (match_id, player_slot)), cent AS (SELECT hero_id, archetype_id, count(*) / sum(count(*)) OVER (PARTITION BY hero_id) AS share, " + ", ".join(f"avg({f}) AS _{f}" for f in FAMILIES) + " FROM fs GROUP BY hero_id, archetype_id)"


@query(
    with_("labels") + ",\n" + SCORES + ",\n" + FAMILY_SHARES + ",\n" + CENTROIDS
    + "\nSELECT match_id, player_slot, archetype_id, round(p / sum(p) OVER (PARTITION BY match_id, player_slot), 6) AS p FROM (SELECT f.match_id, f.player_slot, c.archetype_id, share * exp(-("
    + " + ".join(f"power(f.{f} - _{f}, 2)" for f in FAMILIES)
    + ") / 0.1::double) AS p FROM family_shares f JOIN cent c ON f.hero_id = c.hero_id)"
)
def archetype_posterior(spark: SparkSession, folder: str) -> DataFrame:
    """How likely each archetype is for each seat, given the fixed labels' centroids."""
    players = _family_shares(spark, folder)
    labels = players.select(*SEAT).withColumn("archetype_id", F.pmod(F.col("match_id") + F.col("player_slot"), F.lit(3)).cast("int"))
    cent = players.join(labels, SEAT).groupBy("hero_id", "archetype_id").agg(F.count(F.lit(1)).alias("_n"), *(F.avg(f).alias(f"_{f}") for f in FAMILIES))
    cent = cent.withColumn("share", F.col("_n") / F.sum("_n").over(Window.partitionBy("hero_id"))).drop("_n")
    return clusters.posterior(players, cent, list(FAMILIES), SEAT).withColumn("p", F.round("p", 6))


@query()
def archetype_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of the fits with three and two groups of each hero."""
    _, verdicts = clusters.fit_heroes(stored(_family_shares(spark, folder), "shares"), adapters.buys(spark, folder), list(FAMILIES))
    return verdicts
