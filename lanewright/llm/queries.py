"""Queries of the training-data operators, each over its whole tables, with SQL where it is feasible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from lanewright.llm.markup import section_elements

    return section_elements(table(spark, folder, "sections"))


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    from lanewright.llm.markup import clean_sections

    return clean_sections(table(spark, folder, "sections"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from lanewright.llm.sequences import frequent_orders

    return frequent_orders(table(spark, folder, "purchases")).select("pattern")


def p2_orders(spark: SparkSession, folder: str) -> DataFrame:
    from lanewright.llm.sequences import frequent_orders

    return frequent_orders(table(spark, folder, "purchases"), shortest=2)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from lanewright.llm.pairs import bought_together

    return bought_together(table(spark, folder, "purchases"))


def p4_associations(spark: SparkSession, folder: str) -> DataFrame:
    from lanewright.llm.pairs import associations

    return associations(table(spark, folder, "purchases"), ["match_id", "player_slot"], "item_id").select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from lanewright.llm.topn import top_per_context

    return top_per_context(table(spark, folder, "level_items"), table(spark, folder, "level_offsets"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    from lanewright.llm.quantiles import slow_groups

    return slow_groups(table(spark, folder, "purchases"))


def p6_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Approximate percentiles of buy times per hero and item, within one percent."""
    from lanewright.llm.purchases import distinct_purchases
    from lanewright.llm.quantiles import percentiles, sketch

    sound = table(spark, folder, "purchases").where("item_id is not null and buy_time_s is not null and not isnan(buy_time_s)")
    keys = ["hero_id", "item_id"]
    told = percentiles(sketch(distinct_purchases(sound, [*keys, "buy_time_s"]), keys, "buy_time_s"), keys, [0.05, 0.5, 0.95])
    return told.withColumn("value", F.round("value", 6))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    from lanewright.llm.splits import match_groups

    return match_groups(table(spark, folder, "purchases"))


def p7_splits(spark: SparkSession, folder: str) -> DataFrame:
    from lanewright.llm.splits import match_splits

    return match_splits(table(spark, folder, "purchases"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    from lanewright.llm.tokens import encode_corpus

    return encode_corpus(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    from lanewright.llm.leaks import leaks

    return leaks(table(spark, folder, "documents"), table(spark, folder, "bench_items")).select("doc_id", "bench_id")


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are left once those that hold a leaked passage are removed."""
    from lanewright.llm.leaks import leaks, without_leaks

    documents = table(spark, folder, "documents")
    return without_leaks(documents, leaks(documents, table(spark, folder, "bench_items"))).select("doc_id")


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per test item: documents that hold a passage of it, and the longest in words."""
    from lanewright.llm.leaks import leaks

    return leaks(table(spark, folder, "documents"), table(spark, folder, "bench_items")).groupBy("bench_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("longest"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    from lanewright.llm.truncation import cut_documents

    return cut_documents(table(spark, folder, "documents"))


def p10_sources(spark: SparkSession, folder: str) -> DataFrame:
    from lanewright.llm.truncation import source_report

    return source_report(table(spark, folder, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_orders, p4_found, p4_associations, p5_found, p6_found, p6_percentiles, p7_found, p7_splits, p8_ids, p9_found, p9_clean, p9_items, p10_found, p10_sources)}


#: One row per purchase with item and time, as the operators see it.
ONCE = """once AS (SELECT match_id, player_slot, buy_index, min(hero_id) AS hero_id, min(item_id) AS item_id, min(buy_time_s) AS buy_time_s
  FROM purchases WHERE match_id IS NOT NULL AND player_slot IS NOT NULL AND item_id IS NOT NULL AND buy_time_s IS NOT NULL AND NOT isnan(buy_time_s)
  GROUP BY match_id, player_slot, buy_index)"""


#: Words of texts, and the documents that share twelve of them in a row with an item.
LEAKS = r"""d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT bench_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM bench_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM d, generate_series(1, 100000) t(i) WHERE i <= len(w) - 11),
bg AS (SELECT DISTINCT bench_id, array_to_string(w[i:i + 11], ' ') AS g FROM b, generate_series(1, 100000) t(i) WHERE i <= len(w) - 11),
found AS (SELECT DISTINCT doc_id, bench_id FROM dg JOIN bg USING (g))"""
#: Sequences of seats, and the patterns of each length: those one shorter, each with a later purchase.
STEPS = f"""{ONCE},
seq AS (SELECT dense_rank() OVER (ORDER BY match_id, player_slot) AS s, item_id, row_number() OVER (PARTITION BY match_id, player_slot ORDER BY buy_time_s, buy_index) AS i FROM once),
need AS (SELECT ceil(count(DISTINCT s) * 3 / 100) AS n FROM seq),
one AS (SELECT item_id FROM seq GROUP BY item_id HAVING count(DISTINCT s) >= (SELECT n FROM need)),
kept AS (SELECT * FROM seq WHERE item_id IN (SELECT item_id FROM one)),
at_1 AS (SELECT s, item_id::varchar AS pattern, min(i) AS i FROM kept GROUP BY s, item_id),
""" + ",\n".join(
    f"""all_{k} AS (SELECT a.s, a.pattern || '>' || b.item_id AS pattern, min(b.i) AS i FROM at_{k - 1} a JOIN kept b ON a.s = b.s AND b.i > a.i GROUP BY a.s, a.pattern, b.item_id),
freq_{k} AS (SELECT pattern, count(*) AS n FROM all_{k} GROUP BY pattern HAVING count(*) >= (SELECT n FROM need)),
at_{k} AS (SELECT * FROM all_{k} WHERE pattern IN (SELECT pattern FROM freq_{k}))"""
    for k in range(2, 10)
)


def oracle_sql() -> dict[str, str]:
    growth = 1.01 / 0.99
    return {
        "p2_found": "WITH " + STEPS + "\n" + "\nUNION ALL ".join(f"SELECT pattern FROM freq_{k}" for k in range(3, 10)),
        "p2_orders": "WITH " + STEPS + "\n" + "\nUNION ALL ".join(f"SELECT pattern, {k} AS length, n AS n_seats FROM freq_{k}" for k in range(2, 10)),
        "p6_percentiles": f"""WITH {ONCE},
counts AS (SELECT hero_id, item_id, CASE WHEN buy_time_s = 0 THEN 0 ELSE sign(buy_time_s) * (ceil(ln(abs(buy_time_s)) / ln({growth!r}::double)) + 80000000) END::bigint AS bucket, count(*) AS n FROM once GROUP BY ALL),
upto AS (SELECT *, sum(n) OVER (PARTITION BY hero_id, item_id ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY hero_id, item_id) AS n_group FROM counts)
SELECT hero_id, item_id, share::double AS share, n_group::bigint AS n_group, round(CASE WHEN bucket = 0 THEN 0 ELSE sign(bucket) * exp((abs(bucket) - 80000000) * ln({growth!r}::double)) * (2 / ({growth!r}::double + 1)) END, 6) AS value
FROM upto, (VALUES (0.05), (0.5), (0.95)) s(share) WHERE upto - n < greatest(1, ceil(n_group * share::double)) AND upto >= greatest(1, ceil(n_group * share::double))""",
        "p7_found": """WITH RECURSIVE m AS (SELECT DISTINCT match_id FROM purchases WHERE match_id IS NOT NULL),
t AS (SELECT DISTINCT match_id, account_id FROM purchases WHERE match_id IS NOT NULL AND account_id <> 0),
e AS (SELECT DISTINCT a.match_id AS u, b.match_id AS v FROM t a JOIN t b USING (account_id) WHERE a.match_id <> b.match_id),
r AS (SELECT match_id, match_id AS g FROM m UNION SELECT r.match_id, e.v FROM r JOIN e ON r.g = e.u)
SELECT match_id, min(g) AS group_id FROM r GROUP BY match_id""",
        "p9_found": "WITH " + LEAKS + "\nSELECT doc_id, bench_id FROM found",
        "p9_clean": "WITH " + LEAKS + "\nSELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM found)",
        "p4_found": """WITH seat AS (SELECT DISTINCT match_id, player_slot, item_id FROM purchases WHERE match_id IS NOT NULL AND player_slot IS NOT NULL AND item_id IS NOT NULL),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT match_id, player_slot FROM seat)),
alone AS (SELECT item_id, count(*) AS n FROM seat GROUP BY item_id),
pair AS (SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS n_ab FROM seat a JOIN seat b ON a.match_id = b.match_id AND a.player_slot = b.player_slot AND a.item_id < b.item_id GROUP BY a.item_id, b.item_id)
SELECT item_a, item_b FROM pair JOIN alone a ON a.item_id = item_a JOIN alone b ON b.item_id = item_b, n
WHERE n_ab >= 10 AND n_ab * n.n >= 3 * a.n * b.n""",
        "p4_associations": """WITH seat AS (SELECT DISTINCT match_id, player_slot, item_id FROM purchases WHERE match_id IS NOT NULL AND player_slot IS NOT NULL AND item_id IS NOT NULL),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT match_id, player_slot FROM seat)),
alone AS (SELECT item_id, count(*) AS n FROM seat GROUP BY item_id),
pair AS (SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS n_ab FROM seat a JOIN seat b ON a.match_id = b.match_id AND a.player_slot = b.player_slot AND a.item_id < b.item_id GROUP BY a.item_id, b.item_id)
SELECT item_a, item_b, n_ab, a.n AS n_a, b.n AS n_b, n.n AS n, round(n_ab::double * n.n / (a.n::double * b.n), 6) AS lift
FROM pair JOIN alone a ON a.item_id = item_a JOIN alone b ON b.item_id = item_b, n""",
        "p5_found": """WITH place AS (SELECT DISTINCT * FROM level_items WHERE level_id IS NOT NULL AND item_pos IS NOT NULL AND item_id IS NOT NULL AND weight IS NOT NULL AND NOT isnan(weight))
SELECT level_id, context_id, place::int AS place, item_id FROM (
  SELECT o.level_id, o.context_id, i.item_id, row_number() OVER (PARTITION BY o.level_id, o.context_id ORDER BY i.weight DESC, i.item_id) AS place
  FROM place i JOIN level_offsets o ON i.level_id = o.level_id AND i.item_pos >= o.start_pos AND i.item_pos < o.stop_pos) WHERE place <= 5""",
        "p6_found": f"""WITH {ONCE},
of_group AS (SELECT hero_id, item_id, count(*) AS n, quantile_disc(buy_time_s, 0.5) AS m FROM once WHERE hero_id IS NOT NULL GROUP BY hero_id, item_id),
of_item AS (SELECT item_id, quantile_disc(buy_time_s, 0.5) AS m FROM once GROUP BY item_id)
SELECT hero_id, g.item_id FROM of_group g JOIN of_item i ON g.item_id = i.item_id WHERE n >= 10 AND g.m >= 2 * i.m""",
    }
