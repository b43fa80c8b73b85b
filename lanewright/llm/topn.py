"""Top N items within every group, by merging sorted runs with a loser tree.

Places are tied to contexts by a range join on blocks of places: a context is
listed under each block it covers, long contexts under coarser blocks, so no
context lists more than about ``FAN`` blocks and a hot context is spread over
as many tasks as it has blocks.  Each task sorts its rows by (bucket, group,
score) and stores them as one run, of which a group's first N rows suffice.
The runs of a bucket are then merged by a tree of losers; after N outputs of a
group every run seeks to its next group, so the tail of a group is never read.
A group gets at most N rows per run into the merge, whatever its size.

Defined results: rows without level, place, item or with a null or NaN weight
do not count; a row repeated in full counts once; ties go to the smaller item;
contexts without places, or with a null bound, have no rows; overlapping
contexts each get the shared places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.runtime import stored

#: Places in the finest block, and the most blocks one context is listed under.
BLOCK, FAN = 256, 4096
#: Rows that one bucket of runs should hold.
BUCKET_ROWS = 100_000


def tie_places(places: DataFrame, contexts: DataFrame) -> DataFrame:
    """(level_id, context_id, item_id, weight): distinct sound places with the contexts that own them."""
    bounds = contexts.select("level_id", "context_id", "start_pos", "stop_pos").where(F.col("start_pos") < F.col("stop_pos"))
    longest = bounds.agg(F.max(F.col("stop_pos") - F.col("start_pos"))).first()[0] or 1
    tiers = max(1, math.ceil(math.log(max(longest / BLOCK, 1), FAN) + 1e-9))
    width = lambda tier: F.lit(BLOCK) * F.pow(F.lit(FAN), tier).cast("long")
    tier = F.least(F.lit(tiers - 1), F.greatest(F.lit(0), F.ceil(F.log(float(FAN), (F.col("stop_pos") - F.col("start_pos")) / F.lit(BLOCK))).cast("int") - 1))
    listed = bounds.withColumn("tier", tier).select(
        "level_id", "context_id", "start_pos", "stop_pos", "tier",
        F.explode(F.sequence(F.floor(F.col("start_pos") / width(F.col("tier"))), F.floor((F.col("stop_pos") - 1) / width(F.col("tier"))))).alias("block"),
    )
    sound = places.select("level_id", "item_pos", "item_id", "weight", "n_obs").where(F.col("level_id").isNotNull() & F.col("item_pos").isNotNull() & F.col("item_id").isNotNull() & F.col("weight").isNotNull() & ~F.isnan("weight"))
    at = sound.withColumn("tier", F.explode(F.sequence(F.lit(0), F.lit(tiers - 1)))).withColumn("block", F.floor(F.col("item_pos") / width(F.col("tier"))))
    keys = ["level_id", "tier", "block"]
    once = at.repartition(*keys).dropDuplicates()
    return once.join(listed, keys).where((F.col("item_pos") >= F.col("start_pos")) & (F.col("item_pos") < F.col("stop_pos"))).select("level_id", "context_id", "item_id", "weight")


class LoserTree:
    """Merges sorted runs; each run is (keys, nexts): ascending keys and, for
    each place, the place where the next group begins.  A key's first part is its group."""

    def __init__(self, runs: list[tuple[list, list[int]]]) -> None:
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.head = [keys[0] if keys else None for keys, _ in runs]
        self.loser = [-1] * max(k, 1)  # loser[0] holds the winner
        for leaf in range(k):
            self._enter(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None if x is None else y is None or x <= y

    def _enter(self, leaf: int) -> None:
        """First games: a leaf waits at the first free node for its opponent."""
        node, winner = (leaf + len(self.runs)) // 2, leaf
        while node > 0:
            if self.loser[node] < 0:
                self.loser[node] = winner
                return
            if self._before(self.loser[node], winner):
                self.loser[node], winner = winner, self.loser[node]
            node //= 2
        self.loser[0] = winner

    def _replay(self, leaf: int) -> None:
        node, winner = (leaf + len(self.runs)) // 2, leaf
        while node > 0:
            other = self.loser[node]
            if self._before(other, winner):
                self.loser[node], winner = winner, other
            node //= 2
        self.loser[0] = winner

    def _move(self, run: int, place: int) -> None:
        keys = self.runs[run][0]
        self.at[run] = place
        self.head[run] = keys[place] if place < len(keys) else None
        self._replay(run)

    def first(self, n: int) -> Iterator[tuple[int, tuple]]:
        """(place from 1, key) of the first ``n`` keys of each group."""
        group, place = None, 0
        while self.runs:
            run = self.loser[0]
            key = self.head[run]
            if key is None:
                return
            if key[0] != group:
                group, place = key[0], 0
            if place >= n:
                self._move(run, self.runs[run][1][self.at[run]])  # seek past the group
                continue
            place += 1
            yield place, key
            self._move(run, self.at[run] + 1)


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    change = np.ones(len(columns[0]), bool)
    change[1:] = False
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return change


def _make_run(n: int):
    """Of sorted rows, the first ``n`` of each group, marked with the task's number."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        last, had = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            group = [c.to_numpy() for c in batch.columns[:3]]
            starts = np.flatnonzero(_changes(group))
            rank = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.append(starts, batch.num_rows)))
            if last == tuple(c[0] for c in group):
                rank[: starts[1] if len(starts) > 1 else None] += had
            last, had = tuple(c[-1] for c in group), int(rank[-1]) + 1
            kept = batch.filter(pa.array(rank < n))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(kept.num_rows, run, np.int64)), *kept.columns], ["run", *kept.schema.names])

    return make


def _merge(n: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts)
            run, level, context, weight, item = (rows.column(c).to_numpy() for c in ("run", "level_id", "context_id", "weight", "item_id"))
            keys = list(zip(zip(level.tolist(), context.tolist()), (-weight).tolist(), item.tolist()))
            new = _changes([run, level, context])
            starts = np.flatnonzero(new)
            after = np.append(starts[1:], len(run))
            nexts = np.repeat(after, np.diff(np.append(starts, len(run))))
            cuts = np.append(np.flatnonzero(_changes([run])), len(run)).tolist()
            tree = LoserTree([(keys[a:b], (nexts[a:b] - a).tolist()) for a, b in zip(cuts, cuts[1:])])
            out = [(g[0], g[1], place, x) for place, (g, _, x) in tree.first(n)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["level_id", "context_id", "place", "item_id"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            cuts = np.append(np.flatnonzero(_changes([bucket])), len(bucket)).tolist() if len(bucket) else []
            for a, b in zip(cuts, cuts[1:]):
                if held and held[-1].column("bucket")[0].as_py() != bucket[a]:
                    yield done(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield done(held)

    return merge


def top_per_context(places: DataFrame, contexts: DataFrame, n: int = 5) -> DataFrame:
    """(level_id, context_id, place, item_id): each context's ``n`` heaviest places."""
    buckets = max(1, -(-places.count() // BUCKET_ROWS))
    owned = tie_places(places, contexts).withColumn("bucket", F.pmod(F.xxhash64("level_id", "context_id"), F.lit(buckets)))
    ordered = owned.select("bucket", "level_id", "context_id", "weight", "item_id").sortWithinPartitions("bucket", "level_id", "context_id", F.desc("weight"), "item_id")
    runs = stored(ordered.mapInArrow(_make_run(n), "run long, bucket long, level_id long, context_id long, weight double, item_id long"), "runs")
    return runs.repartition("bucket").sortWithinPartitions("bucket", "run", "level_id", "context_id", F.desc("weight"), "item_id").mapInArrow(_merge(n), "level_id long, context_id long, place int, item_id long")
