"""Items that appear together, counted with large-basket blocking.

A count of rows per basket, combined on the map side, tells huge baskets from
ordinary ones.  An ordinary basket is packed into one run, whose pairs a task
counts at once.  A huge basket is split by item hash before any of its rows
meet: its distinct items are spread over chunks, every chunk is sent, by
explicit keys, to the tasks of its chunk pairs, and each task multiplies two
chunks, so no task ever sees the whole basket.  Both kinds of counts are
combined inside the task, then summed.

Defined results: null items and rows without a full basket key do not count;
an item repeated in a basket counts once; an item makes no pair with itself;
empty input gives no pairs.  Scores: lift = n_ab n / (n_a n_b), pmi = ln lift,
jaccard = n_ab / (n_a + n_b - n_ab).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.purchases import pack_runs
from lanewright.runtime import stored

#: Pairs a task holds before it adds equal ones up; more are passed on to the shuffle.
HELD = 4_000_000
#: Pairs that a product of two chunks makes at a time.
STEP = 1_000_000
#: Rows of a huge basket's chunk, and huge baskets up to which their list is broadcast.
CHUNK, FEW = 2048, 100_000


def _known(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    known = rows.select(*keys, F.col(item).alias("item"))
    for c in known.columns:
        known = known.where(F.col(c).isNotNull())
    return known


def _sized(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it is counted and small, else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= FEW else df


def baskets(rows: DataFrame, keys: list[str], item: str, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame | None]:
    """(keys, part, only, run) of ordinary baskets: the distinct items, ascending; and (keys, chunks, part, item)
    of huge ones (None if there are none): each distinct item with its chunk, one row each."""
    known = _known(rows, keys, item)
    huge = stored(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select(*keys), "huge")
    if huge.isEmpty():
        return pack_runs(known.repartition(*keys).dropDuplicates(), keys, ["item"], "item", chunk), None
    names = _sized(huge)
    small = known.join(names, keys, "left_anti")
    large = stored(known.join(names, keys, "left_semi").distinct(), "large")  # spread by basket and item
    chunks = large.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    split = large.join(_sized(stored(chunks, "chunks")), keys).select(*keys, "chunks", F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int").alias("part"), "item")
    return pack_runs(small.repartition(*keys).dropDuplicates(), keys, ["item"], "item", chunk), split


def _combined(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, place = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(place, weights=np.concatenate(counts), minlength=len(code)).astype(np.int64)


def _pair_counts(products: int = 0):
    """Counter of pairs: within each run, or, with ``products`` key columns before ``side`` and ``item``, of
    the two chunks of every key (side 0 and 1; a chunk with itself has side 2).  Rows come sorted by key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {"a": [], "b": [], "n": []}
        size = 0

        def add(a: np.ndarray, b: np.ndarray) -> None:
            """Equal pairs of one step are added up by items' places in the step."""
            nonlocal size
            if not len(a):
                return
            names, places = np.unique(np.concatenate([a, b]), return_inverse=True)
            k = len(names)
            code = places[: len(a)] * k + places[len(a) :]
            if k * k <= 8 * len(a) + 1_000_000:
                n = np.bincount(code, minlength=k * k)
                code = np.flatnonzero(n)
                n = n[code]
            else:
                code, n = np.unique(code, return_counts=True)
            held["a"].append(names[code // k])
            held["b"].append(names[code % k])
            held["n"].append(n.astype(np.int64))
            size += len(code)

        def flush() -> pa.RecordBatch:
            nonlocal size
            a, b, n = (np.concatenate(held[c]) for c in "abn")
            names, places = np.unique(np.concatenate([a, b]), return_inverse=True)
            code, n = _combined([places[: len(a)] * len(names) + places[len(a) :]], [n])
            a, b = names[code // len(names)], names[code % len(names)]
            held["a"], held["b"], held["n"] = [a], [b], [n]
            size = len(a)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["item_a", "item_b", "n_ab"])

        def spilled() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if size > HELD:
                done = flush()
                if size > HELD // 2:
                    held.update(a=[], b=[], n=[])
                    size = 0
                    yield done

        def product(side: np.ndarray, item: np.ndarray) -> Iterator[pa.RecordBatch]:
            """All pairs of two chunks, or of one with itself, in blocks of rows."""
            same = side[0] == 2
            x, y = (item, item) if same else (item[side == 0], item[side == 1])
            rows = max(1, STEP // max(1, len(y)))
            for k in range(0, len(x), rows):
                a, b = np.repeat(x[k : k + rows], len(y)), np.tile(y, len(x[k : k + rows]))
                keep = a < b if same else slice(None)
                a, b = a[keep], b[keep]
                add(np.minimum(a, b), np.maximum(a, b))
                yield from spilled()

        kept: list[np.ndarray] | None = None
        for batch in batches:
            if products:
                now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                kept = now if kept is None else [np.concatenate([a, b]) for a, b in zip(kept, now)]
                change = np.zeros(len(kept[0]), bool)
                for c in kept[:products]:
                    change[1:] |= c[1:] != c[:-1]
                cuts = [0, *np.flatnonzero(change).tolist()]
                for lo, hi in zip(cuts, cuts[1:]):
                    yield from product(kept[-2][lo:hi], kept[-1][lo:hi])
                kept = [c[cuts[-1] :] for c in kept]  # a key may go on in the next batch
            else:
                runs = batch.column("run")
                values, offsets = runs.flatten().to_numpy(), runs.offsets.to_numpy()
                offsets = offsets - offsets[0]
                stop = np.repeat(offsets[1:], np.diff(offsets))
                more = stop - np.arange(len(values)) - 1
                # about a million pairs at a time, whatever the baskets' sizes
                blocks = np.cumsum(more) // STEP
                for block in np.unique(blocks):
                    lo, hi = np.searchsorted(blocks, [block, block + 1])
                    m = more[lo:hi]
                    first = np.repeat(np.arange(lo, hi), m)
                    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(m) - m, m)
                    add(values[first], values[second])
                    yield from spilled()
        if kept is not None and len(kept[0]):
            yield from product(kept[-2], kept[-1])
        if size:
            yield flush()

    return count


def chunk_products(split: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low, high, side, item): every chunk's items under each of the chunk pairs it takes part in."""
    sent = split.select(*keys, "item", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    side = F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1)
    return sent.select(*keys, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), side.alias("side"), "item")


def pair_counts(packed: DataFrame, split: DataFrame | None, keys: list[str]) -> DataFrame:
    """(item_a, item_b, n_ab), the smaller item first, over the ``baskets`` of both kinds."""
    kind = packed.schema["run"].dataType.elementType.simpleString()
    schema = f"item_a {kind}, item_b {kind}, n_ab long"
    counts = packed.select("run").mapInArrow(_pair_counts(), schema)
    if split is not None:
        pair = [*keys, "low", "high"]
        sent = chunk_products(split, keys).repartition(*pair).sortWithinPartitions(*pair)
        counts = counts.unionByName(sent.mapInArrow(_pair_counts(len(pair)), schema))
    return counts.groupBy("item_a", "item_b").agg(F.sum("n_ab").alias("n_ab"))


def associations(rows: DataFrame, keys: list[str], item: str, at_least: int = 1, chunk: int = CHUNK) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, pmi, jaccard) of pairs in ``at_least`` baskets."""
    packed, split = baskets(rows, keys, item, chunk)
    packed = stored(packed, "baskets")
    n, items = packed.count(), packed.select(F.explode("run").alias("item"))
    if split is not None:
        split = stored(split, "split")
        n += split.select(*keys).distinct().count()
        items = items.unionByName(split.select("item"))
    alone = items.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    pairs = pair_counts(packed, split, keys).where(F.col("n_ab") >= at_least)
    a = alone.select(F.col("item").alias("item_a"), F.col("n_item").alias("n_a"))
    b = alone.select(F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    lift = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return pairs.join(a, "item_a").join(b, "item_b").withColumn("n", F.lit(n).cast("long")).select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), F.ln(lift).alias("pmi"), (F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab"))).alias("jaccard"))


def bought_together(purchases: DataFrame, at_least: int = 10, factor: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(item_a, item_b) that ``at_least`` seats bought both, ``factor`` times more often than chance.

    The test n_ab n >= factor n_a n_b is made in decimals, so no rounding and no overflow.
    """
    scored = associations(purchases, ["match_id", "player_slot"], "item_id", at_least, chunk)
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    return scored.where(exact("n_ab") * exact("n") >= F.lit(factor) * exact("n_a") * exact("n_b")).select("item_a", "item_b")
