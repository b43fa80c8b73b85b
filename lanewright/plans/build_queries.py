"""Queries that grow builds, compare groupings, and read texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewright.functions import text
from lanewright.operators import advice, backoff, builds, cleaning, clusters, evaluation, experiments, families, naming, points, tooltips
from lanewright.plans import adapters, model_queries
from lanewright.plans.adapters import SEAT, with_
from lanewright.plans.cleaning_queries import POINT_ORDER
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


def _components(shop: DataFrame) -> DataFrame:
    """Example of a component table: an item above tier 1 absorbs the nearest cheaper-tier item of its tab by id."""
    lower = shop.where("slot_type is not null").select(F.col("id").alias("part"), "slot_type", (F.col("tier") + 1).alias("tier"))
    upper = shop.where("slot_type is not null and tier >= 2").select(F.col("id").alias("item_id"), "slot_type", "tier")
    return upper.join(lower, ["slot_type", "tier"]).where("part < item_id").groupBy("item_id").agg(F.array(F.max("part")).alias("parts"))


def _builds(spark: SparkSession, folder: str, **options) -> DataFrame:
    bought = stored(adapters.buys(spark, folder), "buys")
    labels = adapters.labels(bought)
    shop = adapters.items(spark, folder)
    level_table = backoff.levels(backoff.row_weights(backoff.prepared(bought, labels, SEAT), SEAT, backoff.TARGET), "weight")
    cells = bought.select("hero_id", *SEAT).distinct().join(labels, SEAT).select("hero_id", "archetype_id").distinct()
    staple = evaluation.staples(bought.join(labels, SEAT), ["hero_id", "archetype_id"], 0.45, 1)
    return builds.generate(level_table, cells, shop, builds.usual_times(bought), _components(shop), staple, **options)


def _last(k: int, n: int, of: str = "bought") -> str:
    return f"coalesce({of}[-{n}], -1)"


def _state_sql(k: int, source: str, clock: str) -> str:
    """``now_<k>``: the key columns of the cells' states before step k."""
    bucket = " + ".join(f"(clock >= {b})::int" for b in cleaning.TIME_BOUNDS)
    return f"now_{k} AS (SELECT *, {_last(k, 1)} AS prev_one, {_last(k, 2)} AS prev_two, {k} AS n_owned, {bucket} AS time_bucket FROM (SELECT s.*, {clock} AS clock FROM {source}))"


def _build_step(k: int, steps: int = builds.STEPS) -> str:
    """Step k of the builds: options of every cell, scored, and the best of them."""
    keys = " AND ".join(f"s.{c} = l.{c}" for c in backoff.KEYS)
    return f"""{_state_sql(k, f"state_{k} s", f"(SELECT t FROM clock_{k})")},
{model_queries.chances_sql(f"(SELECT DISTINCT {', '.join(backoff.KEYS)} FROM now_{k})", "levels", f"likely_{k}")},
due_{k} AS (SELECT s.hero_id, s.archetype_id, item_id, share FROM now_{k} s JOIN staple t USING (hero_id, archetype_id) WHERE NOT list_contains(bought, item_id)),
some_{k} AS (SELECT hero_id, archetype_id, item_id, max(p) AS p, max(share) AS share FROM (SELECT s.hero_id, s.archetype_id, l.item_id, l.p, NULL AS share FROM now_{k} s JOIN likely_{k} l ON {keys} WHERE NOT list_contains(bought, l.item_id)
    UNION ALL SELECT hero_id, archetype_id, item_id, NULL, share FROM due_{k}) GROUP BY ALL),
scaled_{k} AS (SELECT hero_id, archetype_id, item_id, share, coalesce(p / nullif(sum(p) OVER w, 0), 0) AS p, count(share) OVER w AS n_due, list(item_id) FILTER (share IS NOT NULL) OVER w AS due FROM some_{k} WINDOW w AS (PARTITION BY hero_id, archetype_id)),
option_{k} AS (SELECT o.*, parts, held, bought, clock, list_filter(parts, lambda c: NOT list_contains(held, c)) AS missing FROM scaled_{k} o JOIN stock USING (item_id) JOIN now_{k} USING (hero_id, archetype_id)),
score_{k} AS (SELECT *, CASE WHEN share IS NOT NULL AND ({steps - k} <= n_due + 2 OR 12 - len(held) <= n_due) THEN greatest(plain, share * CASE WHEN len(list_filter(missing, lambda c: coalesce(list_contains(due, c), false))) > 0 THEN 0.25::double ELSE 1 END) ELSE plain END AS score
  FROM (SELECT *, p * CASE WHEN len(missing) > 0 THEN 0.25::double ELSE 1 END AS plain FROM option_{k}) WHERE len(held) - (len(parts) - len(missing)) + 1 <= 12),
pick_{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hero_id, archetype_id ORDER BY round(score, 12) DESC, item_id) AS nth FROM score_{k} WHERE score > 0) WHERE nth = 1 AND (p >= 0.02 OR share IS NOT NULL)),
state_{k + 1} AS (SELECT hero_id, archetype_id, list_append(list_filter(held, lambda c: NOT list_contains(parts, c)), item_id) AS held, list_append(bought, item_id) AS bought FROM pick_{k}),
took_{k} AS (SELECT hero_id, archetype_id, {k} AS position, item_id, p, clock AS buy_time_s, list_filter(held, lambda c: list_contains(parts, c)) AS absorbed FROM pick_{k})"""


WEIGHTED = model_queries.LEVELS.replace("count(*)::double AS w", "sum(weight) AS w")
BUILD_SQL = (
    with_("labels") + ",\n" + model_queries.WEIGHTS + ",\n" + model_queries.PREPARED.replace("FROM buys b", "FROM weights b") + ",\n" + WEIGHTED
    + """,
cell AS (SELECT DISTINCT hero_id, archetype_id FROM prepared),
seen AS (SELECT hero_id, archetype_id, item_id, count(*) AS b FROM (SELECT DISTINCT hero_id, archetype_id, match_id, player_slot, item_id FROM prepared) GROUP BY ALL),
many AS (SELECT hero_id, archetype_id, count(*) AS n FROM (SELECT DISTINCT hero_id, archetype_id, match_id, player_slot FROM prepared) GROUP BY ALL),
staple AS (SELECT hero_id, archetype_id, item_id, b / n AS share FROM seen JOIN many USING (hero_id, archetype_id) WHERE b / n >= 0.45),
part AS (SELECT u.id AS item_id, max(l.id) AS part FROM items u JOIN items l ON u.slot_type = l.slot_type AND l.tier + 1 = u.tier AND l.id < u.id WHERE u.tier >= 2 GROUP BY u.id),
stock AS (SELECT id AS item_id, CASE WHEN part IS NULL THEN [] ELSE [part] END AS parts FROM items LEFT JOIN part ON id = item_id),
middle AS (SELECT step, median(buy_time_s) AS t FROM buys GROUP BY step),
clock_0 AS (SELECT greatest(coalesce((SELECT t FROM middle WHERE step = 0), 110), 0) AS t),
"""
    + ",\n".join(f"clock_{k} AS (SELECT greatest(coalesce((SELECT t FROM middle WHERE step = {k}), t + 110), t) AS t FROM clock_{k - 1})" for k in range(1, builds.STEPS))
    + ",\nstate_0 AS (SELECT hero_id, archetype_id, []::bigint[] AS held, []::bigint[] AS bought FROM cell),\n"
    + ",\n".join(map(_build_step, range(builds.STEPS)))
    + ",\nbuild AS (" + "\nUNION ALL ".join(f"SELECT * FROM took_{k}" for k in range(builds.STEPS)) + ")"
)


@query(
    BUILD_SQL
    + """,
eaten AS (SELECT hero_id, archetype_id, unnest(absorbed) AS item_id, buy_time_s AS sell_time_s FROM build)
SELECT hero_id, archetype_id, position, item_id, round(p, 6) AS p, buy_time_s, sell_time_s FROM build LEFT JOIN eaten USING (hero_id, archetype_id, item_id)"""
)
def generated_builds(spark: SparkSession, folder: str) -> DataFrame:
    """The build of every hero and archetype, with what each purchase absorbed."""
    return builds.sell_times(_builds(spark, folder), ["hero_id", "archetype_id", "sample"]).select("hero_id", "archetype_id", "position", "item_id", F.round("p", 6).alias("p"), "buy_time_s", "sell_time_s")


@query()
def build_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each build as one JSON document, grouped by cost."""
    return builds.build_json(_builds(spark, folder), adapters.items(spark, folder), ["hero_id", "archetype_id", "sample"])


@query()
def sampled_staples(spark: SparkSession, folder: str) -> DataFrame:
    """How often sampled builds hold each staple of their cell."""
    bought = adapters.buys(spark, folder)
    staple = evaluation.staples(bought.join(adapters.labels(bought), SEAT), ["hero_id", "archetype_id"], 0.45, 1).select("hero_id", "archetype_id", "item_id")
    drawn = _builds(spark, folder, samples=5, temperature=0.7, seed=1)
    return drawn.join(staple, ["hero_id", "archetype_id", "item_id"], "left_semi").groupBy("hero_id", "archetype_id", "item_id").agg((F.count(F.lit(1)) / 5).alias("share"))


def _order_step(k: int) -> str:
    """Step k of the ability orders: the likeliest slot that can still take a point."""
    keys = " AND ".join(f"s.{c} = l.{c}" for c in backoff.KEYS)
    source = f"state_{k} s LEFT JOIN middle t ON t.hero_id = s.hero_id AND t.step = {k}"
    return f"""{_state_sql(k, source, "greatest(s.since, coalesce(t.median, s.since))")},
{model_queries.chances_sql(f"(SELECT DISTINCT {', '.join(backoff.KEYS)} FROM now_{k})", "levels", f"likely_{k}")},
pick_{k} AS (SELECT * FROM (SELECT s.*, l.item_id, l.p, len(list_filter(bought, lambda x: x = l.item_id)) AS had, row_number() OVER (PARTITION BY s.hero_id, s.archetype_id ORDER BY round(l.p, 12) DESC, l.item_id) AS nth
  FROM now_{k} s JOIN likely_{k} l ON {keys} WHERE len(list_filter(bought, lambda x: x = l.item_id)) < 4) WHERE nth = 1),
state_{k + 1} AS (SELECT hero_id, archetype_id, list_append(bought, item_id) AS bought, clock AS since FROM pick_{k})"""


ORDER_SQL = (
    with_("points")
    + """,
spent AS (SELECT match_id, player_slot, hero_id, signature_slot::bigint AS item_id, game_time_s AS buy_time_s, ((match_id + player_slot) % 3)::int AS archetype_id, row_number() OVER w - 1 AS step FROM points WHERE signature_slot > 0 WINDOW w AS (PARTITION BY match_id, player_slot ORDER BY game_time_s, step)),
prepared AS (SELECT *, lag(item_id, 1, -1) OVER w AS prev_one, lag(item_id, 2, -1) OVER w AS prev_two, step::int AS n_owned,
  (buy_time_s >= 300)::int + (buy_time_s >= 600)::int + (buy_time_s >= 900)::int + (buy_time_s >= 1200)::int + (buy_time_s >= 1800)::int AS time_bucket FROM spent WINDOW w AS (PARTITION BY match_id, player_slot ORDER BY step)),
middle AS (SELECT hero_id, step, min(v) AS median FROM (SELECT *, sum(w) OVER (PARTITION BY hero_id, step ORDER BY v) AS upto, sum(w) OVER (PARTITION BY hero_id, step) AS total FROM (SELECT hero_id, step, buy_time_s AS v, count(*) AS w FROM spent GROUP BY ALL)) WHERE upto >= total / 2 GROUP BY hero_id, step),
"""
    + model_queries.LEVELS + ",\nstate_0 AS (SELECT DISTINCT hero_id, archetype_id, []::bigint[] AS bought, 0.0::double AS since FROM spent),\n" + ",\n".join(map(_order_step, range(16))) + "\n"
    + "\nUNION ALL ".join(f"SELECT hero_id::int AS hero_id, archetype_id, {k} AS position, item_id AS slot, had::int + 1 AS level, round(p, 6) AS p, clock AS game_time_s FROM pick_{k}" for k in range(16))
)


@query(ORDER_SQL)
def ability_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The greedy order of ability points of every hero and archetype."""
    spent = stored(points.as_sequence(adapters.points(spark, folder), SEAT), "spent")
    labels = adapters.labels(spent)
    level_table = backoff.levels(backoff.prepared(spent, labels, SEAT))
    times = points.weighted_median(spent.withColumn("w", F.lit(1)), ["hero_id", "step"], "buy_time_s", "w")
    cells = spent.select("hero_id", *SEAT).distinct().join(labels, SEAT).select("hero_id", "archetype_id").distinct()
    return builds.point_orders(level_table, cells, stored(times, "times")).withColumn("p", F.round("p", 6))


@query(
    with_("labels")
    + """,
t AS (SELECT hero_id, archetype_id, player_slot % 2 AS other, match_id, player_slot FROM (SELECT DISTINCT hero_id, match_id, player_slot FROM buys) JOIN labels USING (match_id, player_slot)),
c AS (SELECT hero_id, archetype_id, other, count(*)::double AS c FROM t GROUP BY ALL),
s AS (SELECT hero_id, sum(c * (c - 1) / 2) AS ij, sum(c) AS n FROM c GROUP BY hero_id),
a AS (SELECT hero_id, sum(c * (c - 1) / 2) AS a FROM (SELECT hero_id, sum(c) AS c FROM c GROUP BY hero_id, archetype_id) GROUP BY hero_id),
b AS (SELECT hero_id, sum(c * (c - 1) / 2) AS b FROM (SELECT hero_id, sum(c) AS c FROM c GROUP BY hero_id, other) GROUP BY hero_id)
SELECT hero_id, n::bigint AS n, round(coalesce((ij - coalesce(a * b / nullif(n * (n - 1) / 2, 0), 0)) / nullif((a + b) / 2 - coalesce(a * b / nullif(n * (n - 1) / 2, 0), 0), 0), 1), 6) AS ari FROM s JOIN a USING (hero_id) JOIN b USING (hero_id)"""
)
def adjusted_rand(spark: SparkSession, folder: str) -> DataFrame:
    bought = adapters.buys(spark, folder)
    rows = bought.select("hero_id", *SEAT).distinct().join(adapters.labels(bought), SEAT).withColumn("other", F.col("player_slot") % 2)
    return experiments.adjusted_rand(rows, "archetype_id", "other", ["hero_id"]).withColumn("ari", F.round("ari", 6))


@query(with_("labels") + ",\n" + model_queries.CLUSTERS + """,
sep AS (SELECT hero_id, arg_min(item_id, (gap, a, b)) AS item_id FROM gaps GROUP BY hero_id), k AS (SELECT item_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, item_id) AS p FROM sep GROUP BY item_id)
SELECT sum(n)::bigint AS n, round(max(n) / sum(n), 9) AS top_share, round(sum(CASE WHEN p <= 3 THEN n ELSE 0 END) / sum(n), 9) AS top_3_share FROM k""")
def separating_items(spark: SparkSession, folder: str) -> DataFrame:
    rows = clusters.separation(clusters.pair_gaps(model_queries._prevalences(spark, folder)))
    return experiments.concentration(rows).select("n", F.round("top_share", 9).alias("top_share"), F.round("top_3_share", 9).alias("top_3_share"))


#: Fixed values of the example, lower than the operator's as the pulls hold few imbues.
FOCUS = {"least": 3, "share": 0.3, "lift": 0.05}


def _focus_sql(source: str) -> str:
    return f"""{source}_t AS (SELECT *, n / own AS share, round(n / own - coalesce((every - n) / nullif(hero - own, 0), 0), 9) AS lift FROM (
  SELECT *, sum(n) OVER (PARTITION BY hero_id, archetype_id) AS own, sum(n) OVER (PARTITION BY hero_id) AS hero, sum(n) OVER (PARTITION BY hero_id, slot) AS every,
    row_number() OVER (PARTITION BY hero_id, archetype_id ORDER BY n DESC, slot) AS p FROM (SELECT hero_id, archetype_id, slot, count(*) AS n FROM {source} GROUP BY ALL))),
{source}_focus AS (SELECT hero_id, archetype_id, slot, lift FROM {source}_t WHERE p = 1 AND own >= {FOCUS["least"]} AND share >= {FOCUS["share"]} AND lift >= {FOCUS["lift"]})"""


@query(
    with_("imbues", "points")
    + """,
aimed AS (SELECT hero_id, ((match_id + player_slot) % 3)::int AS archetype_id, signature_slot AS slot FROM imbues),
maxed AS (SELECT hero_id, ((match_id + player_slot) % 3)::int AS archetype_id, slot FROM (
  SELECT hero_id, match_id, player_slot, arg_min(signature_slot, (game_time_s, step)) FILTER (level >= 4 AND signature_slot > 0) AS slot FROM points GROUP BY hero_id, match_id, player_slot) WHERE slot IS NOT NULL),
"""
    + _focus_sql("aimed") + ",\n" + _focus_sql("maxed")
    + "\nSELECT * FROM aimed_focus UNION ALL SELECT * FROM maxed_focus m WHERE NOT EXISTS (SELECT 1 FROM aimed_focus a WHERE a.hero_id = m.hero_id AND a.archetype_id = m.archetype_id)"
)
def archetype_focus(spark: SparkSession, folder: str) -> DataFrame:
    """The ability each group of players centres on, by its imbues, else by what it maxes first."""
    flat = adapters.pulls(spark, folder, "item")
    aimed = stored(adapters.imbues(spark, folder, flat)[0], "imbues")
    maxed = stored(points.first_maxed(adapters.points(spark, folder, flat), ["hero_id", *SEAT]), "maxed")
    labels = adapters.labels(aimed.select(*SEAT).unionByName(maxed.select(*SEAT)))
    return naming.ability_focus(aimed, maxed, labels, SEAT, **FOCUS)


@query(
    with_("labels") + ",\n" + model_queries.CLUSTERS + ",\n" + model_queries.SCORES
    + """,
idf AS (SELECT family, ln((SELECT count(*) FROM items) / count(DISTINCT item_id)) AS idf FROM scores GROUP BY family),
lifts AS (SELECT hero_id, archetype_id, item_id, round(p - coalesce((sum(p) OVER w - p) / nullif(count(p) OVER w - 1, 0), 0), 9) AS lift FROM prev WINDOW w AS (PARTITION BY hero_id, item_id)),
led AS (SELECT *, row_number() OVER (PARTITION BY hero_id, archetype_id ORDER BY round(s, 9) DESC, family DESC) AS p FROM (
  SELECT hero_id, archetype_id, family, sum(greatest(lift, 0) * score * idf) AS s FROM lifts JOIN scores USING (item_id) JOIN idf USING (family) GROUP BY ALL)),
two AS (SELECT hero_id, archetype_id, max(family) FILTER (p = 1) AS f1, max(s) FILTER (p = 1) AS s1, max(family) FILTER (p = 2) AS f2, max(s) FILTER (p = 2) AS s2 FROM led GROUP BY ALL),
named AS (SELECT hero_id, archetype_id, round(m, 6) AS margin, CASE WHEN s1 <= 0 OR m < 1.3 THEN hero_id::varchar ELSE concat(f1, CASE WHEN m < 1.7 THEN concat('-', f2) ELSE '' END, ' ', hero_id) END AS name FROM (
  SELECT *, CASE WHEN coalesce(s2, 0) > 0 THEN s1 / s2 ELSE 'inf'::double END AS m FROM two)),
best AS (SELECT hero_id, archetype_id, string_split_regex(trim(name), '\\s+')[-1] AS item FROM (SELECT *, row_number() OVER (PARTITION BY hero_id, archetype_id ORDER BY lift DESC, item_id) AS p FROM lifts) JOIN items ON item_id = id WHERE p = 1),
told AS (SELECT n.*, item, count(*) OVER w AS n, count(DISTINCT item) OVER w AS d, row_number() OVER (PARTITION BY hero_id, name ORDER BY archetype_id) AS r FROM named n LEFT JOIN best USING (hero_id, archetype_id) WINDOW w AS (PARTITION BY hero_id, name)),
once AS (SELECT *, CASE WHEN n < 2 THEN name WHEN d = n THEN concat(item, ' ', name) ELSE concat(name, ' ', r) END AS label FROM told)
SELECT hero_id, archetype_id, name, margin, CASE WHEN row_number() OVER v > 1 THEN concat(label, ' ', row_number() OVER v) ELSE label END AS "unique" FROM once WINDOW v AS (PARTITION BY hero_id, label ORDER BY archetype_id)"""
)
def archetype_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the groups by the families of what sets them apart, told apart by their most distinctive item."""
    shop, cell = adapters.items(spark, folder), ["hero_id", "archetype_id"]
    scores = stored(model_queries._scores(spark, folder), "scores")
    lifts = stored(clusters.discriminative(model_queries._prevalences(spark, folder), 1 << 30), "lifts")
    scored = families.scored_families(lifts.select(*cell, "item_id", "lift"), scores, families.rarity(scores, shop.count()), cell)
    named = families.names(scored, cell, "hero_id").join(naming.item_label(lifts, shop), cell, "left")
    told = naming.unique_names(named.withColumn("focus", F.lit(None).cast("string")).withColumn("fixed", F.lit(None).cast("string")))
    return told.select(*cell, "name", F.round("margin", 6).alias("margin"), "unique")


POINT_BASE = {"overall": ["hero_id"], "positional": ["hero_id", "archetype_id", "step"], "bigram": ["hero_id", "archetype_id", "prev_one"]}


def _point_accuracy_sql() -> str:
    lists = ",\n".join(f"by_{name} AS (SELECT {', '.join(keys)}, item_id, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY count(*) DESC, item_id) AS place FROM train GROUP BY {', '.join(keys)}, item_id)" for name, keys in POINT_BASE.items())
    model = "(SELECT *, row_number() OVER (PARTITION BY " + ", ".join(backoff.KEYS) + " ORDER BY p DESC, item_id) AS place FROM likely)"
    tables = {name: (f"by_{name}", keys) for name, keys in POINT_BASE.items()} | {"backoff": (model, list(backoff.KEYS))}
    score = lambda name, source, keys: f"""SELECT '{name}' AS model, count(*) AS n, round(avg((coalesce(first_, -1) = item_id)::int), 9) AS top_1 FROM (SELECT t.match_id, t.player_slot, t.step, t.item_id, arg_min(l.item_id, l.place) AS first_
  FROM test t LEFT JOIN {source} l ON {" AND ".join(f"t.{k} = l.{k}" for k in keys)} AND NOT list_contains(t.full_, l.item_id) GROUP BY ALL)"""  # noqa: E731
    return (
        with_("points")
        + """,
spent AS (SELECT match_id, player_slot, hero_id, signature_slot::bigint AS item_id, game_time_s AS buy_time_s, ((match_id + player_slot) % 3)::int AS archetype_id, row_number() OVER w - 1 AS step FROM points WHERE signature_slot > 0 WINDOW w AS (PARTITION BY match_id, player_slot ORDER BY game_time_s, step)),
prepared AS (SELECT *, lag(item_id, 1, -1) OVER w AS prev_one, lag(item_id, 2, -1) OVER w AS prev_two, step::int AS n_owned,
  (buy_time_s >= 300)::int + (buy_time_s >= 600)::int + (buy_time_s >= 900)::int + (buy_time_s >= 1200)::int + (buy_time_s >= 1800)::int AS time_bucket,
  list_filter([1, 2, 3, 4], lambda s: len(list_filter(coalesce(list(item_id) OVER (PARTITION BY match_id, player_slot ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []), lambda x: x = s)) >= 4) AS full_ FROM spent WINDOW w AS (PARTITION BY match_id, player_slot ORDER BY step)),
side AS (SELECT match_id, rn <= floor(n * 0.75) AS is_train FROM (SELECT match_id, row_number() OVER (ORDER BY md5('0:' || match_id::varchar), match_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT match_id FROM spent))),
train AS (SELECT p.* FROM prepared p JOIN side USING (match_id) WHERE is_train), test AS (SELECT p.* FROM prepared p JOIN side USING (match_id) WHERE NOT is_train AND len(full_) < 3),
"""
        + model_queries.LEVELS.replace("FROM prepared", "FROM train") + ",\n" + model_queries.chances_sql("(SELECT DISTINCT " + ", ".join(backoff.KEYS) + " FROM test)", "levels", "likely") + ",\n" + lists + "\n"
        + "\nUNION ALL ".join(score(name, *told) for name, told in tables.items())
        + "\nUNION ALL SELECT 'chance', count(*), round(avg(1 / (4 - len(full_))), 9) FROM test"
    )


@query(_point_accuracy_sql())
def point_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """How often the next ability point is the first guess among the slots that can still take one, by model and baselines,
    over every held-out point with a choice."""
    spent = points.as_sequence(adapters.points(spark, folder), SEAT)
    labels = adapters.labels(spent)
    order = Window.partitionBy(*SEAT).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    full = F.array_compact(F.array(*(F.when(F.sum((F.col("item_id") == s).cast("int")).over(order) >= advice.TOP, F.lit(s).cast("long")) for s in points.SLOTS)))
    rows = stored(backoff.prepared(spent.withColumn("owned", full), labels, SEAT), "points")
    train, test = model_queries._sided(rows, "match")
    test = stored(test.where(F.size("owned") < 3), "test")
    told = backoff.ranked(test.select(*backoff.KEYS, "owned", "item_id"), backoff.state_tables(test, stored(backoff.levels(train), "levels")))
    hits = {"backoff": told.select(F.when(F.try_element_at("best", F.lit(1))["item_id"] == F.col("item_id"), 1).alias("hit"))}
    for name, context in POINT_BASE.items():
        hits[name] = evaluation.hit_places(test, evaluation.ranked_lists(train, context), context)
    out = [evaluation.accuracy(df).select(F.lit(name).alias("model"), "n", F.round("top_1", 9).alias("top_1")) for name, df in hits.items()]
    out.append(test.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(1 / (4 - F.size("owned"))), 9).alias("top_1")).select(F.lit("chance").alias("model"), "n", "top_1"))
    return model_queries._together(out)


@query(
    with_("buys") + ",\n" + model_queries.SCORES + ",\n" + model_queries.FAMILY_SHARES
    + ",\ntabs AS (SELECT match_id, player_slot, "
    + ", ".join(f"coalesce(sum(CASE WHEN slot_type = '{s}' THEN coalesce(cost, 0) ELSE 0 END) / nullif(sum(coalesce(cost, 0)), 0), 0) AS t_{f}" for s, f in model_queries.TAB.items())
    + " FROM buys b JOIN items i ON b.item_id = i.id WHERE slot_type IS NOT NULL GROUP BY match_id, player_slot)\nSELECT f.match_id, f.player_slot, round(("
    + " + ".join(f"abs({f} - t_{f})" for f in model_queries.TAB.values())
    + ") / 2, 9) AS distance FROM family_shares f JOIN tabs t ON f.match_id = t.match_id AND f.player_slot = t.player_slot"
)
def tab_family_distance(spark: SparkSession, folder: str) -> DataFrame:
    shares = model_queries._family_shares(spark, folder)
    tabs = families.slot_shares(adapters.buys(spark, folder), adapters.items(spark, folder), list(model_queries.TAB), SEAT)
    return experiments.share_distance(shares, tabs, {f: s for s, f in model_queries.TAB.items()}, SEAT).withColumn("distance", F.round("distance", 9))


@query()
def hero_permutation(spark: SparkSession, folder: str) -> DataFrame:
    """Do heroes with an even number win more often?  A permutation test over heroes."""
    rows = adapters.buys(spark, folder).groupBy("hero_id").agg(F.avg(F.col("won").cast("double")).alias("rate"))
    return experiments.permutation_test(rows.withColumn("even", F.col("hero_id") % 2 == 0), "rate", "even", "hero_id")


#: Fixed values of the example: which tier of which slot unlocks which effect.
EFFECTS = [(1, 2, "control"), (1, 3, "damage"), (2, 2, "damage"), (2, 4, "area"), (3, 3, "control"), (4, 2, "area"), (4, 4, "damage")]


def _exposed(spark: SparkSession, folder: str) -> DataFrame:
    ordered = points.point_order(adapters.points(spark, folder), [*SEAT, "hero_id"])
    return points.exposure(ordered, [*SEAT, "hero_id"])


EXPOSED = "exposed AS (" + " UNION ALL ".join(f"SELECT match_id, player_slot, hero_id, {s} AS slot, {L} AS level, 1 - pt_{s}_l{L} AS e FROM ordered" for s in (1, 2, 3, 4) for L in (2, 3, 4)) + ")"


@query(with_("points") + ",\n" + POINT_ORDER + ",\n" + EXPOSED + ",\neffects(slot, level, category) AS (VALUES " + ", ".join(f"({s}, {L}, '{c}')" for s, L, c in EFFECTS) + ")\nSELECT match_id, player_slot, category, round(avg(e), 9) AS e FROM exposed JOIN effects USING (slot, level) GROUP BY ALL")
def effect_exposure(spark: SparkSession, folder: str) -> DataFrame:
    exposed = _exposed(spark, folder)
    effects = exposed.select("hero_id").distinct().withColumn("x", F.explode(F.array(*(F.struct(F.lit(s).alias("slot"), F.lit(L).alias("level"), F.lit(c).alias("category")) for s, L, c in EFFECTS)))).select("hero_id", "x.*")
    return points.effect_shares(exposed, effects, SEAT).withColumn("e", F.round("e", 9))


@query(with_("points") + ",\n" + POINT_ORDER + ",\n" + EXPOSED + """
SELECT match_id, player_slot, round(coalesce(sum(CASE WHEN slot = hero_id % 4 + 1 THEN e * c ELSE 0 END) / nullif(sum(e * c), 0), 0), 9) AS w FROM (SELECT *, CASE level WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 5 END AS c FROM exposed) GROUP BY match_id, player_slot""")
def routed_exposure(spark: SparkSession, folder: str) -> DataFrame:
    exposed = _exposed(spark, folder)
    routed = exposed.select("hero_id").distinct().withColumn("slot", (F.col("hero_id") % 4 + 1).cast("int"))
    return points.routed_share(exposed, routed, SEAT).withColumn("w", F.round("w", 9))


@query("""SELECT section_id, trim(regexp_replace(regexp_replace(regexp_replace(prose, '(?is)<svg.*?</svg>', ' ', 'g'), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS plain FROM sections WHERE prose IS NOT NULL""")
def tooltip_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sections").where("prose is not null").select("section_id", text.stripped(F.col("prose")).alias("plain"))


@query()
def sanitised_prose(spark: SparkSession, folder: str) -> DataFrame:
    """Prose with only allowed tags and attributes; a parser's work, so without SQL (tested on golden texts)."""
    return table(spark, folder, "sections").select("section_id", text.sanitise("prose").alias("safe"))


SENTENCE = r"""coalesce(nullif(regexp_extract(bare, '^(.+?[.!?])(\s|$)', 1), ''), nullif(bare, '')) AS sentence FROM (SELECT *, trim(regexp_replace(regexp_replace(prose, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS bare FROM sections)"""


@query(f"SELECT section_id, {SENTENCE}")
def first_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sections").select("section_id", text.first_sentence(F.col("prose")).alias("sentence"))


@query(
    f"""WITH s AS (SELECT section_id, item_id, coalesce(kind = 'innate', false) AS late, list_filter(conditions, lambda x: length(x) > 0)[1] AS named, {SENTENCE} WHERE item_id IS NOT NULL)
SELECT item_id, coalesce(arg_min(named, (late, section_id)) FILTER (named IS NOT NULL), arg_min(sentence, section_id) FILTER (sentence IS NOT NULL)) AS headline FROM s GROUP BY item_id"""
)
def item_headlines(spark: SparkSession, folder: str) -> DataFrame:
    return tooltips.section_headlines(table(spark, folder, "sections"))


@query("""SELECT item_id, kind, count(*) AS n_sections, sum(len(conditions))::bigint AS n_conditions FROM sections WHERE item_id IS NOT NULL AND kind IS NOT NULL GROUP BY item_id, kind""")
def tooltip_sections(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "sections").where("item_id is not null and kind is not null")
    return known.groupBy("item_id", "kind").agg(F.count(F.lit(1)).alias("n_sections"), F.sum(F.when(F.col("conditions").isNotNull(), F.size("conditions"))).alias("n_conditions"))


@query(
    """WITH e AS (SELECT user_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT event_type, next_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 9) AS share FROM (
  SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY step) AS next_type FROM e) WHERE next_type IS NOT NULL GROUP BY event_type, next_type"""
)
def event_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """What follows each kind of event, as a share."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, folder, "events").select("event_type", F.lead("event_type").over(order).alias("next_type")).where("next_type is not null")
    counts = rows.groupBy("event_type", "next_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 9))
