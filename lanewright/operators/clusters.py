"""Groups of players per hero: fits, merging, checks.

Lloyd's steps run for all heroes, all starts, all numbers of clusters and both
samples (all players, and the half on which a fit is replicated) at once, until
no assignment changes.  Centroids are a bounded number of rows (heroes x runs x
clusters) that are broadcast; a step is one pass over the players in which every
task adds up its own members, so nothing but those sums is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewright.functions.stats import correlation
from lanewright.operators.evaluation import prevalence
from lanewright.runtime import stored

#: Thresholds of the four checks and the least number of players.
SEPARATION, SILHOUETTE, REPLICATION, SMALLEST, PLAYERS = 0.45, 0.15, 0.90, 0.12, 600
#: Players per hero in the silhouette, which compares pairs; larger heroes are sampled by hash.
SAMPLE = 4000


class Run(NamedTuple):
    """One descent: number of clusters, whether it sees only the training half, and its start."""

    k: int
    half: bool
    start: int


Centroids = dict[tuple[int, Run], np.ndarray]


def _members(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of each run's centroids (runs, k, columns) for each row, and its squared distance; ties to the first."""
    d = ((x[:, None, None, :] - centroids[None]) ** 2).sum(-1)
    return d.argmin(2), d.min(2)


def _steps(players: DataFrame, columns: list[str], centroids: Centroids) -> list:
    """(hero_id, run, cluster, n, d, mark, sums): what every cluster of every run holds now.  ``mark`` stands for who is in it."""
    runs = sorted({run for _, run in centroids})
    by_hero: dict[int, dict[Run, np.ndarray]] = {}
    for (hero, run), at in centroids.items():
        by_hero.setdefault(hero, {})[run] = at
    shared = players.sparkSession.sparkContext.broadcast((runs, by_hero))
    names = ["hero_id", "run", "cluster", "n", "d", "mark", *(f"_{i}" for i in range(len(columns)))]
    schema = "hero_id int, run int, cluster int, n long, d double, mark long" + "".join(f", _{i} double" for i in range(len(columns)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, by_hero = shared.value
        number = {run: i for i, run in enumerate(runs)}
        told: dict[tuple, list] = {}
        for batch in batches:
            hero, half, mark = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hero_id", "_half", "_mark"))
            x = np.stack([batch.column(c).to_numpy() for c in columns], 1)
            for h in np.unique(hero):
                for kind in sorted({(run.k, run.half) for run in by_hero.get(h, ())}):
                    own = [run for run in by_hero[h] if (run.k, run.half) == kind]
                    rows = np.flatnonzero((hero == h) & (half if kind[1] else True))
                    near, d = _members(x[rows], np.stack([by_hero[h][run] for run in own]))
                    for r, run in enumerate(own):
                        for c in np.unique(near[:, r]):
                            inside = near[:, r] == c
                            at = rows[inside]
                            sums = told.setdefault((h, number[run], int(c)), [0, 0.0, 0, np.zeros(len(columns))])
                            sums[0] += len(at)
                            sums[1] += float(d[inside, r].sum())
                            sums[2] ^= int(np.bitwise_xor.reduce(mark[at]))
                            sums[3] = sums[3] + x[at].sum(0)
        if told:
            flat = [(*key, n, d, m, *v) for key, (n, d, m, v) in told.items()]
            yield pa.RecordBatch.from_pydict({name: pa.array([f[i] for f in flat], t) for i, (name, t) in enumerate(zip(names, [pa.int32()] * 3 + [pa.int64(), pa.float64(), pa.int64()] + [pa.float64()] * len(columns)))})

    summed = players.select("hero_id", "_half", "_mark", *columns).mapInArrow(step, schema).groupBy("hero_id", "run", "cluster").agg(F.sum("n"), F.sum("d"), F.bit_xor("mark"), *(F.sum(f"_{i}") for i in range(len(columns))))
    out = [(r[0], runs[r[1]], *r[2:]) for r in summed.collect()]  # heroes x runs x clusters
    shared.unpersist()
    return out


def prepared_players(players: DataFrame, columns: list[str]) -> DataFrame:
    """Players with a hero, their columns as doubles, a hash of each and the half it belongs to (by match)."""
    rows = players.where(F.col("hero_id").isNotNull())
    for c in columns:
        rows = rows.where(F.col(c).isNotNull())
    half = F.pmod(F.xxhash64(F.lit("half"), "match_id"), F.lit(2)) == 0
    return stored(rows.select(F.col("hero_id").cast("int"), "match_id", "player_slot", *(F.col(c).cast("double") for c in columns), half.alias("_half"), F.xxhash64("match_id", "player_slot").alias("_mark")), "players")


def fits(players: DataFrame, columns: list[str], ks: tuple[int, ...], starts: int = 10, steps: int = 300, halves: bool = True) -> dict[tuple[int, bool], dict[int, np.ndarray]]:
    """(k, half) -> hero -> centroids of the best of ``starts`` descents over ``prepared_players``.

    Starts pick k players of a hero by hash, so a fit can be repeated.  A descent ends when a step changes no
    player's cluster, or after ``steps`` steps; only descents that still move are computed."""
    # one player of each of k classes of hashes, for each hero and run, combined on the map side
    runs = [Run(k, half, start) for k in ks for half in ((False, True) if halves else (False,)) for start in range(starts)]
    table = F.array(*(F.struct(F.lit(i).alias("run"), F.lit(r.k).alias("k"), F.lit(r.half).alias("half"), F.lit(r.start).alias("start")) for i, r in enumerate(runs)))
    drawn = players.withColumn("r", F.explode(table)).where(~F.col("r.half") | F.col("_half"))
    h = F.xxhash64("r.start", "_mark")
    picked = drawn.groupBy("hero_id", F.col("r.run").alias("run"), F.pmod(h, F.col("r.k")).cast("int").alias("cluster")).agg(F.min_by(F.struct(*columns), F.struct(h.alias("h"), "_mark")).alias("at"))
    centroids: Centroids = {}
    for r in picked.collect():  # heroes x runs x clusters
        run = runs[r["run"]]
        centroids.setdefault((r["hero_id"], run), np.full((run.k, len(columns)), np.inf))[r["cluster"]] = r["at"]
    best: dict[tuple[int, bool], dict[int, tuple]] = {(k, half): {} for k in ks for half in (False, True)}
    marks: dict = {}
    for step in range(steps):
        if not centroids:
            break
        told: dict[tuple, list] = {}
        for r in _steps(players, columns, centroids):
            told.setdefault((r[0], r[1]), []).append(r[2:])
        moving: Centroids = {}
        for (hero, run), own in told.items():
            mark = {c: (m, n) for c, n, _, m, *_ in own}
            if marks.get((hero, run)) == mark or step == steps - 1:
                end = (round(sum(r[2] for r in own), 9), run.start)
                kept = best[run.k, run.half]
                if hero not in kept or end < kept[hero][0]:
                    kept[hero] = (end, centroids[hero, run])
            else:
                marks[hero, run] = mark
                at = np.full((run.k, len(columns)), np.inf)
                for c, n, _, _, *sums in own:
                    at[c] = np.array(sums) / n
                moving[hero, run] = at
        centroids = moving
    return {key: {hero: at for hero, (_, at) in kept.items()} for key, kept in best.items()}


def assigned(players: DataFrame, columns: list[str], centroids: dict[int, np.ndarray]) -> DataFrame:
    """(hero_id, match_id, player_slot, columns, _half, cluster): each player's nearest centroid.  No shuffle."""
    shared = players.sparkSession.sparkContext.broadcast(centroids)
    names = ["hero_id", "match_id", "player_slot", *columns, "_half"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hero = batch.column("hero_id").to_numpy()
            x = np.stack([batch.column(c).to_numpy() for c in columns], 1)
            cluster = np.zeros(len(hero), np.int32)
            for h in np.unique(hero):
                if h in shared.value:
                    rows = np.flatnonzero(hero == h)
                    cluster[rows] = _members(x[rows], shared.value[h][None])[0][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster)], [*names, "cluster"])

    schema = ", ".join(f"{c} {players.schema[c].dataType.simpleString()}" for c in names) + ", cluster int"
    return players.select(*names).mapInArrow(place, schema)


def in_order(labelled: DataFrame, first: str, label: str = "cluster") -> DataFrame:
    """``labelled`` with ``archetype_id`` for its label: 0, 1, ... by the mean of the column ``first``, highest first."""
    means = labelled.groupBy("hero_id", label).agg(F.avg(first).alias("m"))
    order = means.select("hero_id", label, (F.row_number().over(Window.partitionBy("hero_id").orderBy(F.desc("m"), label)) - 1).alias("_place"))
    return labelled.join(F.broadcast(order), ["hero_id", label]).drop(label).withColumnRenamed("_place", "archetype_id")


def fit(players: DataFrame, columns: list[str], k: int, starts: int = 10, steps: int = 300) -> DataFrame:
    """(hero_id, match_id, player_slot, columns, archetype_id 0..k-1) of the best start of each hero, numbered by the
    first column's mean, highest first."""
    rows = prepared_players(players, columns)
    chosen = stored(assigned(rows, columns, fits(rows, columns, (k,), starts, steps, halves=False)[k, False]), "assigned")
    return in_order(chosen, columns[0]).select("hero_id", "match_id", "player_slot", *columns, "archetype_id")


def cluster_prevalence(bought: DataFrame, labels: DataFrame) -> DataFrame:
    """(hero_id, archetype_id, item_id, p) for every item of the hero, 0 where a cluster never bought it."""
    rows = bought.join(labels, ["match_id", "player_slot"])
    own = prevalence(rows, ["hero_id", "archetype_id"]).select("hero_id", "archetype_id", "item_id", F.col("share").alias("p"))
    clusters = own.select("hero_id", "archetype_id").distinct()
    every = own.select("hero_id", "item_id").distinct().join(clusters, "hero_id")
    return every.join(own, ["hero_id", "archetype_id", "item_id"], "left").select("hero_id", "archetype_id", "item_id", F.coalesce("p", F.lit(0.0)).alias("p"))


def pair_gaps(prev: DataFrame) -> DataFrame:
    """(hero_id, a, b, gap, item_id): largest prevalence gap of each pair of clusters and its item (smallest id on a tie)."""
    left = prev.select("hero_id", "item_id", F.col("archetype_id").alias("a"), F.col("p").alias("pa"))
    right = prev.select("hero_id", "item_id", F.col("archetype_id").alias("b"), F.col("p").alias("pb"))
    both = left.join(right, ["hero_id", "item_id"]).where("a < b").withColumn("g", F.round(F.abs(F.col("pa") - F.col("pb")), 9))
    return both.groupBy("hero_id", "a", "b").agg(F.max(F.struct("g", (-F.col("item_id")).alias("i"))).alias("m")).select("hero_id", "a", "b", F.col("m.g").alias("gap"), (-F.col("m.i")).alias("item_id"))


def separation(gaps: DataFrame) -> DataFrame:
    """(hero_id, separation, item_id) of the weakest pair."""
    return gaps.groupBy("hero_id").agg(F.min(F.struct("gap", "a", "b", "item_id")).alias("m")).select("hero_id", F.col("m.gap").alias("separation"), F.col("m.item_id").alias("item_id"))


def merged(labelled: DataFrame, bought: DataFrame, first: str, k: int, threshold: float = SEPARATION) -> DataFrame:
    """``labelled`` with each hero's least distinct pair of clusters made one, again and again until all pairs' largest
    gaps reach ``threshold``; prevalences are taken anew after each merge, and clusters numbered in order."""
    labelled = labelled.select("hero_id", "match_id", "player_slot", *(c for c in labelled.columns if c not in ("hero_id", "match_id", "player_slot")))
    for _ in range(k - 1):
        gaps = pair_gaps(cluster_prevalence(bought, labelled.select("match_id", "player_slot", "archetype_id")))
        weakest = gaps.groupBy("hero_id").agg(F.min(F.struct("gap", "a", "b")).alias("m")).where(F.col("m.gap") < threshold).select("hero_id", "m.a", "m.b")
        weakest = stored(weakest, "weakest")
        if weakest.isEmpty():
            break
        moved = F.when(F.col("archetype_id") == F.col("b"), F.col("a")).otherwise(F.col("archetype_id"))
        labelled = stored(labelled.join(F.broadcast(weakest), "hero_id", "left").withColumn("archetype_id", F.when(F.col("a").isNull(), F.col("archetype_id")).otherwise(moved)).drop("a", "b"), "merged")
    return in_order(labelled, first, "archetype_id")


def discriminative(prev: DataFrame, top: int = 15) -> DataFrame:
    """(hero_id, archetype_id, place, item_id, lift): prevalence less the plain mean of the other clusters."""
    total = F.sum("p").over(Window.partitionBy("hero_id", "item_id"))
    n = F.count("p").over(Window.partitionBy("hero_id", "item_id"))
    rows = prev.withColumn("lift", F.round(F.col("p") - F.coalesce(F.try_divide(total - F.col("p"), n - 1), F.lit(0.0)), 9))
    place = F.row_number().over(Window.partitionBy("hero_id", "archetype_id").orderBy(F.desc("lift"), "item_id"))
    return rows.withColumn("place", place).where(F.col("place") <= top).select("hero_id", "archetype_id", "place", "item_id", "lift")


def silhouette(labelled: DataFrame, columns: list[str], sample: int = SAMPLE) -> DataFrame:
    """(hero_id, silhouette): mean Euclidean silhouette over about ``sample`` players of a hero, chosen by hash.

    The sample is drawn before the groups are formed, so what a group holds does not grow with the data."""
    keys = [c for c in labelled.columns if c not in (*columns, "hero_id", "archetype_id")]
    n = labelled.groupBy("hero_id").agg(F.count(F.lit(1)).alias("_n"))
    share = F.lit(float(sample)) / F.col("_n")
    drawn = labelled.join(F.broadcast(n), "hero_id").where(F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) < share * 1_000_000)

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows[columns].to_numpy(float), rows["archetype_id"].to_numpy()
        value = math.nan
        if len(np.unique(y)) > 1:
            sums = np.zeros((len(x), y.max() + 1))
            for i in range(0, len(x), 500):
                d = np.sqrt(np.maximum(((x[i : i + 500, None, :] - x[None]) ** 2).sum(-1), 0))
                for c in np.unique(y):
                    sums[i : i + 500, c] = d[:, y == c].sum(1)
            size = np.bincount(y, minlength=sums.shape[1])
            own = sums[np.arange(len(x)), y] / np.maximum(size[y] - 1, 1)
            other = np.where((np.arange(sums.shape[1]) != y[:, None]) & (size > 0), sums / np.maximum(size, 1), np.inf).min(1)
            s = np.where(size[y] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
            value = float(s.mean())
        return pd.DataFrame({"hero_id": [rows["hero_id"].iloc[0]], "silhouette": [value]})

    kind = labelled.schema["hero_id"].dataType.simpleString()
    return drawn.select("hero_id", "archetype_id", *columns).groupBy("hero_id").applyInPandas(score, f"hero_id {kind}, silhouette double")


def replication(bought: DataFrame, halves: DataFrame, least: int = 50) -> DataFrame:
    """(hero_id, replication): mean correlation of the clusters' prevalences between the half they were fitted on and
    the other one.  ``halves``: players assigned by a fit on one half (hero_id, seat, _half, cluster); null where
    a half has fewer than ``least`` players for each cluster."""
    rows = bought.drop("hero_id").join(halves.select("hero_id", "match_id", "player_slot", "_half", "cluster"), ["match_id", "player_slot"])
    p = prevalence(rows, ["hero_id", "cluster", "_half"]).groupBy("hero_id", "cluster", "item_id").agg(*(F.coalesce(F.max(F.when(F.col("_half") == h, F.col("share"))), F.lit(0.0)).alias(f"h{int(h)}") for h in (True, False)))
    r = p.groupBy("hero_id", "cluster").agg(correlation("h0", "h1").alias("r")).groupBy("hero_id").agg(F.avg(F.when(~F.isnan("r"), F.col("r"))).alias("replication"))
    sizes = halves.groupBy("hero_id").agg(F.count(F.when(F.col("_half"), 1)).alias("a"), F.count(F.when(~F.col("_half"), 1)).alias("b"), (F.max("cluster") + 1).alias("k"))
    return r.join(sizes.where(F.least("a", "b") >= F.col("k") * least).select("hero_id"), "hero_id", "left_semi")


def checks(labelled: DataFrame, bought: DataFrame, columns: list[str], replicated: DataFrame) -> DataFrame:
    """(hero_id, k, n, separation, silhouette, replication, smallest, passed, reason): NaN and null fail; ``k`` counts the clusters left."""
    labels = labelled.select("match_id", "player_slot", "archetype_id")
    sizes = labelled.groupBy("hero_id", "archetype_id").agg(F.count(F.lit(1)).alias("c")).groupBy("hero_id").agg(F.count(F.lit(1)).cast("int").alias("k"), F.sum("c").alias("n"), (F.min("c") / F.sum("c")).alias("smallest"))
    gaps = separation(pair_gaps(cluster_prevalence(bought, labels))).select("hero_id", "separation")
    all_ = sizes.join(gaps, "hero_id", "left").join(silhouette(labelled, columns), "hero_id", "left").join(replicated, "hero_id", "left")
    good = lambda c, t: F.coalesce(~F.isnan(c) & (F.col(c) >= t), F.lit(False))
    rules = {"players": F.col("n") >= PLAYERS, "merged": F.col("k") > 1, "separation": good("separation", SEPARATION), "silhouette": good("silhouette", SILHOUETTE), "replication": good("replication", REPLICATION), "smallest": good("smallest", SMALLEST)}
    failed = F.filter(F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    told = all_.withColumn("passed", F.size(failed) == 0).withColumn("reason", F.when(F.size(failed) == 0, "passes").otherwise(F.concat(F.lit("fails "), F.array_join(failed, ", "))))
    return told.select("hero_id", "k", "n", "separation", "silhouette", "replication", "smallest", "passed", "reason")


def fit_heroes(players: DataFrame, bought: DataFrame, columns: list[str], ks: tuple[int, ...] = (3, 2), starts: int = 10) -> tuple[DataFrame, DataFrame]:
    """Labels (hero_id, match_id, player_slot, archetype_id) and verdicts (``tried`` is the k of the fit): each hero takes
    the largest k whose merged clusters pass every check, else one group."""
    rows = prepared_players(players, columns)
    found = fits(rows, columns, ks, starts)
    bought = stored(bought.select("match_id", "player_slot", "hero_id", "item_id").distinct(), "bought")
    taken, verdicts = None, None
    for k in sorted(ks, reverse=True):
        first = in_order(stored(assigned(rows, columns, found[k, False]), f"fit{k}"), columns[0])
        labelled = stored(merged(first, bought, columns[0], k), f"labels{k}").drop("_half")
        again = replication(bought, stored(assigned(rows, columns, found[k, True]), f"half{k}"))
        told = checks(labelled, bought, columns, again).withColumn("tried", F.lit(k))
        own = labelled.select("match_id", "player_slot", "archetype_id", F.lit(k).alias("best"))
        verdicts, taken = (told, own) if taken is None else (verdicts.unionByName(told), taken.unionByName(own))
    verdicts = stored(verdicts, "verdicts")
    best = verdicts.where("passed").groupBy("hero_id").agg(F.max("tried").alias("best"))
    keyed = players.select("hero_id", "match_id", "player_slot").join(best, "hero_id", "left")
    return keyed.join(taken, ["match_id", "player_slot", "best"], "left").select("hero_id", "match_id", "player_slot", F.coalesce("archetype_id", F.lit(0)).alias("archetype_id")), verdicts


def posterior(players: DataFrame, centroids: DataFrame, columns: list[str], keys: list[str], temperature: float = 0.1) -> DataFrame:
    """(keys, archetype_id, p): prior share times exp(-squared distance / temperature), made to sum to 1.

    ``centroids``: hero_id, archetype_id, share and the columns with ``_`` before them."""
    near = players.join(F.broadcast(centroids), "hero_id")
    distance = sum((F.pow(F.col(c) - F.col(f"_{c}"), 2) for c in columns[1:]), F.pow(F.col(columns[0]) - F.col(f"_{columns[0]}"), 2))
    raw = near.select(*keys, "archetype_id", (F.col("share") * F.exp(-distance / temperature)).alias("_p"))
    return raw.select(*keys, "archetype_id", F.try_divide("_p", F.sum("_p").over(Window.partitionBy(*keys))).alias("p"))


def scaled_block(block: DataFrame, columns: list[str], weight: float) -> DataFrame | None:
    """The block times weight over its rows' mean absolute sum; None if that is nothing."""
    size = block.agg(F.avg(sum((F.abs(F.col(c)) for c in columns[1:]), F.abs(F.col(columns[0]))))).first()[0]
    if weight <= 0 or not size:
        return None
    return block.select(*(c for c in block.columns if c not in columns), *((F.col(c) * (weight / size)).alias(c) for c in columns))
