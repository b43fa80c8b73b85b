"""Complete orders of purchases and of ability points, grown cell by cell.

The level tables are packed to one row per context and brought together once
for each cell (hero and archetype), together with its staples and clocks; a
cell then grows its whole orders in one task, all cells in parallel.  A cell's
table is bounded by the shop, not by the data: pairs of last items times
buckets times items at most.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.operators.backoff import KAPPA, LEVELS, NO_ITEM, PLACES
from lanewright.operators.cleaning import TIME_BOUNDS
from lanewright.operators.ranking import global_rank

#: Steps, score factor for items whose parts are missing, least chance, slots, and steps kept free for staples.
STEPS, PENALTY, LEAST, SLOTS, RESERVE = 17, 0.25, 0.02, 12, 2
#: Purchases a game usually has by number, in seconds; later ones follow at equal gaps.
GAP_S = 110
#: Kinds of rows that travel to a cell beside its contexts: staples with shares, and points with usual times.
STAPLES, CLOCKS = -1, -2


def usual_times(bought: DataFrame, steps: int = STEPS) -> list[float]:
    """Median time of the first ``steps`` purchases; a missing one follows the last after ``GAP_S``.

    Middles are picked by rank over range partitions: no task holds all times of a step."""
    early = bought.where((F.col("step") < steps) & F.col("buy_time_s").isNotNull()).select("step", "buy_time_s")
    middle = global_rank(early, ["step"], ["buy_time_s"]).where((F.col("rank") * 2 >= F.col("rank_n")) & (F.col("rank") * 2 <= F.col("rank_n") + 2))
    told = {r["step"]: r["t"] for r in middle.groupBy("step").agg(F.avg("buy_time_s").alias("t")).collect()}
    out: list[float] = []
    for k in range(steps):
        out.append(max(told.get(k, (out[-1] if out else 0.0) + GAP_S), out[-1] if out else 0.0))
    return out


def _packed(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """``rows`` as (keys, items, weights): two arrays of equal length, ascending by value."""
    both = F.array_sort(F.collect_list(F.struct(F.col(value).cast("long").alias("x"), F.col(weight).cast("double").alias("w"))))
    packed = rows.groupBy(*keys).agg(both.alias("b"))
    return packed.select(*keys, F.transform("b", lambda e: e["x"]).alias("items"), F.transform("b", lambda e: e["w"]).alias("weights"))


def cell_tables(level_table: DataFrame, cells: DataFrame, staples: DataFrame | None = None, clocks: DataFrame | None = None) -> DataFrame:
    """(hero_id, archetype_id, level, ctx, items, weights): all that a cell needs to grow its orders."""
    cells = cells.select(F.col("hero_id").cast("int"), F.col("archetype_id").cast("int")).distinct()
    part = F.split("ctx", r"\|")
    own = F.when(F.col("level").isin(*(k for k, keys in enumerate(LEVELS) if "archetype_id" in keys)), part[1].cast("int"))
    contexts = _packed(level_table.select(part[0].cast("int").alias("hero_id"), own.alias("own"), "level", "ctx", "item_id", "w"), ["hero_id", "own", "level", "ctx"], "item_id", "w")
    columns = ["hero_id", "archetype_id", "level", "ctx", "items", "weights"]
    out = contexts.join(cells, "hero_id").where(F.col("own").isNull() | (F.col("own") == F.col("archetype_id"))).select(*columns)
    if staples is not None:
        due = _packed(staples, ["hero_id", "archetype_id"], "item_id", "share").withColumn("level", F.lit(STAPLES)).withColumn("ctx", F.lit(""))
        out = out.unionByName(due.join(cells, ["hero_id", "archetype_id"], "left_semi").select(*columns))
    if clocks is not None:
        at = _packed(clocks, ["hero_id"], "step", "median").withColumn("level", F.lit(CLOCKS)).withColumn("ctx", F.lit(""))
        out = out.unionByName(at.join(cells, "hero_id").select(*columns))
    return out


class Cell:
    """The contexts of one cell, and the mixture of levels for a state."""

    def __init__(self, table: pa.Table, kappa: float) -> None:
        self.hero, self.archetype, self.kappa = table.column("hero_id")[0].as_py(), table.column("archetype_id")[0].as_py(), kappa
        lists = table.column("items").combine_chunks()
        self.items, self.offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        self.weights = table.column("weights").combine_chunks().values.to_numpy()
        self.place = {key: i for i, key in enumerate(zip(table.column("level").to_pylist(), table.column("ctx").to_pylist()))}

    def at(self, level: int, ctx: str = "") -> tuple[list[int], np.ndarray]:
        i = self.place.get((level, ctx))
        lo, hi = (self.offsets[i], self.offsets[i + 1]) if i is not None else (0, 0)
        return self.items[lo:hi].tolist(), self.weights[lo:hi]

    def chances(self, bought: list[int], clock: float) -> dict[int, float]:
        """Each item's chance after ``bought``, at ``clock``: the two fine levels, and what they leave times the others' mixture."""
        state = {
            "hero_id": self.hero, "archetype_id": self.archetype, "n_owned": len(bought), "time_bucket": bisect_right(TIME_BOUNDS, clock),
            "prev_one": bought[-1] if bought else NO_ITEM, "prev_two": bought[-2] if len(bought) > 1 else NO_ITEM,
        }

        def mixture(levels: range) -> tuple[dict[int, float], float]:
            out: dict[int, float] = {}
            left = 1.0
            for level in levels:
                items, weights = self.at(level, "|".join(str(state[k]) for k in LEVELS[level]))
                total = float(weights.sum())
                if total > 0:
                    own = total / (total + self.kappa)
                    for x, w in zip(items, weights.tolist()):
                        out[x] = out.get(x, 0.0) + left * own / total * w
                    left *= 1 - own
            return {x: round(p, PLACES) for x, p in out.items()}, left

        fine, rest = mixture(range(2))
        coarse, _ = mixture(range(2, len(LEVELS)))
        return {x: fine.get(x, 0.0) + rest * coarse.get(x, 0.0) for x in fine.keys() | coarse.keys()}


def _grown(tables: DataFrame, grow: Callable[[Cell], Iterator[tuple]], kappa: float, schema: str) -> DataFrame:
    """The rows that ``grow`` makes of each cell, behind its hero and archetype."""
    columns = tables.sparkSession.createDataFrame([], "hero_id int, archetype_id int, " + schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(columns)

    def one(table: pa.Table) -> pa.Table:
        cell = Cell(table, kappa)
        rows = [(cell.hero, cell.archetype, *r) for r in grow(cell)]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(target)], schema=target)

    return tables.groupBy("hero_id", "archetype_id").applyInArrow(one, columns)


def generate(
    level_table: DataFrame,
    cells: DataFrame,
    shop: DataFrame,
    times: list[float],
    components: DataFrame | None = None,
    staples: DataFrame | None = None,
    samples: int = 1,
    temperature: float = 0.0,
    seed: int = 0,
    kappa: float = KAPPA,
) -> DataFrame:
    """(hero_id, archetype_id, sample, position, item_id, p, buy_time_s, absorbed) of each cell's build.

    ``components`` (item_id, parts array) are absorbed when held; an item with
    missing parts scores less.  ``staples`` (hero_id, archetype_id, item_id,
    share) are forced in when steps or slots run out.  With a temperature an
    item is drawn by its score to the power 1 / T, else the best is taken
    (ties to the smaller id).  A build ends when the best chance is below
    ``LEAST`` and no staple is due.
    """
    # the shop has a few hundred rows, whatever the data
    parts: dict[int, list[int]] = {r["id"]: [] for r in shop.select("id").collect()}
    for r in components.collect() if components is not None else ():
        parts[r["item_id"]] = list(r["parts"])

    def grow(cell: Cell) -> Iterator[tuple]:
        shares = dict(zip(*(list(x) for x in cell.at(STAPLES))))
        for sample in range(samples):
            draw = np.random.default_rng([seed, cell.hero, cell.archetype, sample])
            held: list[int] = []
            bought: list[int] = []
            for position, clock in enumerate(times):
                seen = set(bought)
                chances = {x: p for x, p in cell.chances(bought, clock).items() if x not in seen}
                whole = sum(chances.values())
                due = {x: s for x, s in shares.items() if x not in seen}
                pressed = len(times) - position <= len(due) + RESERVE or SLOTS - len(held) <= len(due)
                best = None
                for x in sorted(chances.keys() | due.keys()):
                    if x not in parts:
                        continue
                    missing = [c for c in parts[x] if c not in held]
                    p = chances.get(x, 0.0) / whole if whole > 0 else 0.0
                    score = p * (PENALTY if missing else 1.0)
                    if x in due and pressed:
                        score = max(score, due[x] * (PENALTY if any(c in due for c in missing) else 1.0))
                    noise = draw.random() if temperature > 0 else 0.0
                    if score <= 0 or len(held) - (len(parts[x]) - len(missing)) + 1 > SLOTS:
                        continue
                    key = math.log(score) / temperature - math.log(-math.log(max(noise, 1e-300))) if temperature > 0 else round(score, 12)
                    if best is None or key > best[0]:
                        best = (key, x, p)
                if best is None or (best[2] < LEAST and best[1] not in due):
                    break
                _, x, p = best
                absorbed = [c for c in held if c in parts[x]]
                held = [c for c in held if c not in parts[x]] + [x]
                bought.append(x)
                yield sample, position, x, p, float(clock), absorbed

    tables = cell_tables(level_table, cells, staples)
    return _grown(tables, grow, kappa, "sample int, position int, item_id long, p double, buy_time_s double, absorbed array<bigint>")


def sell_times(build: DataFrame, keys: list[str]) -> DataFrame:
    """The build with ``sell_time_s``: when a later purchase absorbed the item; null if it is kept."""
    eaten = build.select(*keys, F.explode("absorbed").alias("item_id"), F.col("buy_time_s").alias("sell_time_s"))
    return build.join(eaten, [*keys, "item_id"], "left")


def point_orders(level_table: DataFrame, cells: DataFrame, times: DataFrame, n_points: int = 16, top: int = 4, kappa: float = KAPPA) -> DataFrame:
    """(hero_id, archetype_id, position, slot, level, p, game_time_s): each cell's greedy order of
    ability points; a slot takes ``top`` points.  ``times``: (hero_id, step, median)."""

    def grow(cell: Cell) -> Iterator[tuple]:
        usual = dict(zip(*(list(x) for x in cell.at(CLOCKS))))
        bought: list[int] = []
        clock = 0.0
        for position in range(n_points):
            clock = max(clock, float(usual.get(position, clock)))
            open_ = [(round(p, 12), -x) for x, p in cell.chances(bought, clock).items() if bought.count(x) < top]
            if not open_:
                return
            p, x = max(open_)
            bought.append(-x)
            yield position, -x, bought.count(-x), p, clock

    return _grown(cell_tables(level_table, cells, clocks=times), grow, kappa, "position int, slot long, level int, p double, game_time_s double")


def build_json(build: DataFrame, shop: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): each build as nested JSON, kept items grouped by cost, in order of purchase."""
    kept = sell_times(build, keys).where("sell_time_s is null").join(F.broadcast(shop.select(F.col("id").alias("item_id"), "name", F.coalesce("cost", F.lit(0)).alias("cost"))), "item_id")
    tier = kept.groupBy(*keys, "cost").agg(F.array_sort(F.collect_list(F.struct("position", "item_id", "name", F.round("p", 6).alias("p"), "buy_time_s"))).alias("mods"))
    whole = tier.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cost", "mods"))).alias("categories"), F.sum(F.col("cost") * F.size("mods")).alias("total_cost"))
    return whole.select(*keys, F.to_json(F.struct(*keys, "total_cost", "categories")).alias("json"))


#: Kind of currency and amount that a point of each level takes, and the size of a section.
POINT_COST = ((2, 1), (1, 1), (1, 2), (1, 5))
WIDTH, HEIGHT = 1030.0, 0.0


def _about(verb: str, seconds: Column, p: Column) -> Column:
    return F.format_string(verb + "~%dmin (p=%.2f)", F.floor(seconds / 60), p)


def point_changes(orders: DataFrame, slots: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ability_order): each cell's points in order, as changes of currency of the ability in the slot
    (hero_id, signature_slot, ability_id)."""
    known = orders.join(F.broadcast(slots.select("hero_id", F.col("signature_slot").cast("long").alias("slot"), "ability_id")), ["hero_id", "slot"])
    kind, amount = (F.element_at(F.array(*(F.lit(c[i]) for c in POINT_COST)), F.col("level")) for i in (0, 1))
    change = F.struct("position", F.struct("ability_id", kind.alias("currency_type"), amount.alias("delta"), _about("", F.col("game_time_s"), F.col("p")).alias("annotation")).alias("c"))
    return known.groupBy(*keys).agg(F.struct(F.transform(F.array_sort(F.collect_list(change)), lambda x: x["c"]).alias("currency_changes")).alias("ability_order"))


def import_json(build: DataFrame, shop: DataFrame, keys: list[str], targets: DataFrame | None = None, orders: DataFrame | None = None, title: str = "build") -> DataFrame:
    """(keys, json): each build as the document that the game's build browser reads: kept items in sections by cost,
    with the ability each is imbued on (keys, item_id, ability_id) and the ability order (keys, ability_order) where given."""
    kept = sell_times(build, keys).where("sell_time_s is null").join(F.broadcast(shop.select(F.col("id").alias("item_id"), F.coalesce("cost", F.lit(0)).alias("cost"))), "item_id")
    kept = kept.join(targets.select(*keys, "item_id", F.col("ability_id").alias("_target")), [*keys, "item_id"], "left") if targets is not None else kept.withColumn("_target", F.lit(None).cast("long"))
    null = lambda kind: F.lit(None).cast(kind)
    mod = F.struct(
        F.col("item_id").alias("ability_id"), _about("buy ", F.col("buy_time_s"), F.col("p")).alias("annotation"), null("int").alias("required_flex_slots"),
        null("int").alias("sell_priority"), F.col("_target").alias("imbue_target_ability_id"),
    )
    tier = kept.groupBy(*keys, "cost").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", mod.alias("m")))), lambda x: x["m"]).alias("mods"))
    section = F.struct("cost", F.struct(F.concat(F.col("cost").cast("string"), F.lit(" souls")).alias("name"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), null("string").alias("description"), "mods", null("boolean").alias("optional")).alias("s"))
    rows = tier.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(section)), lambda x: x["s"]).alias("mod_categories"))
    rows = rows.join(orders, keys, "left") if orders is not None else rows
    details = F.struct("mod_categories", *(["ability_order"] if orders is not None else []))
    whole = F.struct(F.col("hero_id"), F.concat_ws(" ", F.lit(title), *(F.col(k).cast("string") for k in keys)).alias("name"), F.lit("").alias("description"), F.lit(0).alias("language"), F.lit(1).alias("version"), F.array().cast("array<string>").alias("tags"), details.alias("details"))
    return rows.select(*keys, F.to_json(F.struct(whole.alias("hero_build")), {"ignoreNullFields": "false"}).alias("json"))
