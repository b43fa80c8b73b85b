"""Frequent ordered patterns with gaps, mined level by level.

Level k joins frequent patterns of length k-1 that overlap in k-2 items, drops
candidates with an infrequent subpattern, broadcasts the rest as a hash tree
(node, item) -> node, and counts in how many sequences each candidate occurs.
A sequence walks the tree from the root by the earliest next occurrence of an
item, which reaches a node exactly if the sequence holds the node's pattern.
Each task sends one count per candidate, so a level shuffles at most tasks
times candidates rows; the candidate list itself is cut into blocks of
``block`` candidates, each with a pass of its own, so what is broadcast has a
fixed bound and no candidate is left out.

Sequences are packed once into arrays of bounded length; one that is longer
than an array is counted in a streaming pass that keeps only the set of
reached nodes, so no sequence is ever held as a whole.

Defined results: events without item, order value or sequence key do not
count; ties in the order go by the second order column; an empty table has no
patterns; an item may recur in a pattern.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.llm.purchases import CHUNK, distinct_purchases, pack_runs
from lanewright.runtime import stored

Pattern = tuple[int, ...]


class HashTree:
    """Candidates of one length as a tree of (node, item) -> node."""

    def __init__(self, candidates: list[Pattern], items: np.ndarray) -> None:
        self.items = items  # ascending; codes are places in it
        k = len(items)
        code = {int(x): i for i, x in enumerate(items)}
        edges: dict[int, int] = {}
        self.leaf = np.zeros(len(candidates), np.int64)
        n = 1
        for c, pattern in enumerate(candidates):
            node = 0
            for x in pattern:
                key = node * k + code[x]
                if key not in edges:
                    edges[key] = n
                    n += 1
                node = edges[key]
            self.leaf[c] = node
        self.depth = len(candidates[0])
        self.n = n
        self.keys = np.array(sorted(edges), np.int64)
        self.nodes = np.array([edges[key] for key in sorted(edges)], np.int64)

    def table(self) -> np.ndarray | None:
        """The edges as a flat table, if that is small."""
        k = len(self.items)
        if self.n * k > 20_000_000:
            return None
        flat = np.zeros(self.n * k, np.int32)
        flat[self.keys] = self.nodes
        return flat

    def step(self, flat: np.ndarray | None, node: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Next nodes; 0 where the tree has no such edge."""
        key = node * len(self.items) + item
        if flat is not None:
            return flat[key]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.nodes[place], 0)


def _walk(tree: HashTree, flat: np.ndarray | None, values: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> None:
    """Adds to ``counts`` (by node) the sequences of one batch that hold each leaf."""
    seq = np.repeat(np.arange(len(sizes)), sizes)
    place = np.minimum(np.searchsorted(tree.items, values), len(tree.items) - 1)
    known = tree.items[place] == values
    item, seq = place[known], seq[known]
    if not len(item):
        return
    at = np.arange(len(item))
    order = np.lexsort((at, item, seq))
    same = (item[order][1:] == item[order][:-1]) & (seq[order][1:] == seq[order][:-1])
    before = np.full(len(item), -1)
    before[order[1:][same]] = order[:-1][same]  # the same item's last place in the sequence
    stop = np.searchsorted(seq, seq, side="right")
    node = tree.step(flat, np.zeros(len(item), np.int64), item)
    live = (before < 0) & (node > 0)
    end, node = at[live], node[live].astype(np.int64)
    for depth in range(1, tree.depth):
        more = stop[end] - end - 1
        ends, nodes = [], []
        blocks = np.cumsum(more) // 2_000_000
        for block in np.unique(blocks):
            lo, hi = np.searchsorted(blocks, [block, block + 1])
            m = more[lo:hi]
            base = np.repeat(end[lo:hi], m)
            nxt = base + 1 + np.arange(len(base)) - np.repeat(np.cumsum(m) - m, m)
            fresh = before[nxt] <= base  # the first such item after the node's end
            nxt = nxt[fresh]
            to = tree.step(flat, np.repeat(node[lo:hi], m)[fresh], item[nxt])
            hit = to > 0
            if depth == tree.depth - 1:
                counts += np.bincount(to[hit], minlength=tree.n)
            else:
                ends.append(nxt[hit])
                nodes.append(to[hit].astype(np.int64))
        if depth < tree.depth - 1:
            end, node = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ends, nodes))
    if tree.depth == 1:
        counts += np.bincount(node, minlength=tree.n)


def _counter(tree_of, streaming: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: HashTree = tree_of()
        flat = tree.table()
        counts = np.zeros(tree.n, np.int64)
        if streaming:
            parents, codes = tree.keys // len(tree.items), tree.keys % len(tree.items)
            order = np.argsort(codes, kind="stable")
            bounds = np.searchsorted(codes[order], np.arange(len(tree.items) + 1))
            parents, targets = parents[order], tree.nodes[order]
            reached, now = np.zeros(tree.n, bool), None
            for batch in batches:
                for *key, run in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.columns[-1]):
                    if key != now:
                        counts += reached
                        reached[:] = False
                        reached[0], now = True, key
                    values = run.values.to_numpy()
                    place = np.minimum(np.searchsorted(tree.items, values), len(tree.items) - 1)
                    for i in place[tree.items[place] == values]:
                        a, b = bounds[i], bounds[i + 1]
                        reached[targets[a:b][reached[parents[a:b]]]] = True
            counts += reached
        else:
            for batch in batches:
                runs = batch.column("run")
                _walk(tree, flat, runs.flatten().to_numpy(), np.diff(runs.offsets.to_numpy()), counts)
        got = counts[tree.leaf]
        some = np.flatnonzero(got)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(got[some])], ["candidate", "n"])

    return count


def _supports(packed: DataFrame, keys: list[str], candidates: list[Pattern], items: np.ndarray, need: int) -> dict[Pattern, int]:
    """The candidates that at least ``need`` sequences hold, with their counts."""
    spark = packed.sparkSession
    shared = spark.sparkContext.broadcast(HashTree(candidates, items))
    tree_of = lambda: shared.value
    schema = "candidate long, n long"
    short = packed.where("only").select("run").mapInArrow(_counter(tree_of, False), schema)
    long = packed.where("not only").repartition(*keys).sortWithinPartitions(*keys, "part").select(*keys, "run").mapInArrow(_counter(tree_of, True), schema)
    found = short.unionByName(long).groupBy("candidate").agg(F.sum("n").alias("n")).where(F.col("n") >= need).collect()  # at most one row per candidate of this block
    shared.unpersist()
    return {candidates[r["candidate"]]: r["n"] for r in found}


def _joined(frequent: dict[Pattern, int]) -> list[Pattern]:
    """Candidates one longer, all of whose subpatterns are frequent."""
    by_head: dict[Pattern, list[int]] = {}
    for p in sorted(frequent):
        by_head.setdefault(p[:-1], []).append(p[-1])
    out = []
    for p in sorted(frequent):
        for x in by_head.get(p[1:], ()):
            q = (*p, x)
            if all(q[:i] + q[i + 1 :] in frequent for i in range(1, len(q) - 1)):
                out.append(q)
    return out


def mine(packed: DataFrame, keys: list[str], share: tuple[int, int] = (3, 100), block: int = 100_000, longest: int | None = None) -> tuple[dict[Pattern, int], int]:
    """All patterns held by at least ``share`` of the sequences, and the number of sequences."""
    n = packed.where("part = 0").count()
    need = max(1, -(-share[0] * n // share[1]))
    singles = packed.select(*keys, F.explode(F.array_distinct("run")).alias("item"), "only")
    once = singles.where("only").select("item").unionByName(singles.where("not only").select(*keys, "item").distinct().select("item"))
    found = {(r["item"],): r["n"] for r in once.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need).collect()}  # at most (mean length) * share items
    items = np.array(sorted(p[0] for p in found), np.int64)
    level, every = found, dict(found)
    while level and (longest is None or len(next(iter(level))) < longest):
        candidates = _joined(level)
        level = {}
        for i in range(0, len(candidates), block):
            part = candidates[i : i + block]
            level |= _supports(packed, keys, part, items, need)
        every |= level
    return every, n


def purchase_sequences(purchases: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Packed sequences of seats: purchases with item and time, by time, then buy_index."""
    sound = purchases.where(F.col("item_id").isNotNull() & F.col("buy_time_s").isNotNull() & ~F.isnan("buy_time_s"))
    keys = ["match_id", "player_slot"]
    bought = distinct_purchases(sound, ["item_id", "buy_time_s"], by_seat=True)
    return pack_runs(bought, keys, ["buy_time_s", "buy_index"], "item_id", chunk)


def frequent_orders(purchases: DataFrame, share: tuple[int, int] = (3, 100), shortest: int = 3) -> DataFrame:
    """(pattern, length, n_seats): orders of ``shortest`` or more items, ids joined by ``>``."""
    packed = stored(purchase_sequences(purchases), "sequences")
    every, _ = mine(packed, ["match_id", "player_slot"], share)
    rows = [(">".join(map(str, p)), len(p), n) for p, n in sorted(every.items()) if len(p) >= shortest]
    return _frame(purchases.sparkSession, rows)


def _frame(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, "pattern string, length int, n_seats long")
