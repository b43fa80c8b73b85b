"""Purchases as the mining operators see them: each once, packed per seat.

Rows that agree in (match_id, player_slot, buy_index) are one purchase.  If
such rows disagree elsewhere, the smallest non-null value of each column
counts.  Rows without match_id or player_slot belong to no seat; rows without
buy_index are each taken as the purchase with index null of their seat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most values in one packed row; longer runs continue in the next row.
CHUNK = 4096


def distinct_purchases(purchases: DataFrame, columns: list[str], by_seat: bool = False) -> DataFrame:
    """One row per purchase with ``columns``.

    ``by_seat``: leave all rows of a seat in one partition (one exchange on
    the seat, in which the purchase groups nest); otherwise the exchange is on
    the whole purchase key, which spreads a hot seat.
    """
    keys = ["match_id", "player_slot"]
    rows = purchases.select(*keys, "buy_index", *columns).where(F.col("match_id").isNotNull() & F.col("player_slot").isNotNull())
    if by_seat:
        rows = rows.repartition(*keys)
    return rows.groupBy(*keys, "buy_index").agg(*(F.min(c).alias(c) for c in columns))


def pack_runs(rows: DataFrame, keys: list[str], order: list[str], value: str, chunk: int = CHUNK) -> DataFrame:
    """Rows of each key as arrays of at most ``chunk`` values, in ``order``.

    ``rows`` must already hold each key in one partition.  The partition is
    sorted and streamed, so no group is ever held as a whole: a key with more
    than ``chunk`` values gives several rows (``part`` 0, 1, ...), and ``only``
    tells those keys apart that fit into one.
    """
    head = [rows.schema[k].dataType.simpleString() for k in keys]
    schema = ", ".join([*(f"{k} {t}" for k, t in zip(keys, head)), "part int", "only boolean", f"run array<{rows.schema[value].dataType.simpleString()}>"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        part = 0

        def emit(columns: list[np.ndarray], starts: np.ndarray, stops: np.ndarray, parts: np.ndarray, only: np.ndarray, types: list) -> pa.RecordBatch:
            offsets = pa.array(np.concatenate([starts, stops[-1:]]).astype(np.int32))
            runs = pa.ListArray.from_arrays(offsets, pa.array(columns[-1], type=types[-1]))
            heads = [pa.array(c[starts], type=t) for c, t in zip(columns[:-1], types)]
            return pa.RecordBatch.from_arrays([*heads, pa.array(parts.astype(np.int32)), pa.array(only), runs], [*keys, "part", "only", "run"])

        types: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [c.type for c in batch.columns]
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            kept = now if kept is None else [np.concatenate([a, b]) for a, b in zip(kept, now)]
            change = np.zeros(len(kept[0]), bool)
            change[0] = True
            for c in kept[:-1]:
                change[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(change)
            last = starts[-1]  # the run that may go on in the next batch
            if len(starts) > 1:
                yield from _chunks(kept, starts[:-1], starts[1:], part, chunk, True, lambda *a: emit(*a, types))
                kept, part = [c[last:] for c in kept], 0
            while len(kept[0]) > chunk:
                piece = [c[:chunk] for c in kept]
                yield emit(piece, np.array([0]), np.array([chunk]), np.array([part]), np.array([False]), types)
                kept, part = [c[chunk:] for c in kept], part + 1
        if kept is not None:
            yield from _chunks(kept, np.array([0]), np.array([len(kept[0])]), part, chunk, True, lambda *a: emit(*a, types))

    return rows.select(*keys, *order, value).sortWithinPartitions(*keys, *order).select(*keys, value).mapInArrow(pack, schema)


def _chunks(columns, starts, stops, part, chunk, ended, emit):
    """Packed rows of ended runs; ``part`` numbers what the first run already gave."""
    sizes = stops - starts
    pieces = np.maximum(1, -(-sizes // chunk))
    owner = np.repeat(np.arange(len(starts)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = starts[owner] + number * chunk
    last = np.minimum(first + chunk, stops[owner])
    parts = number + np.where(owner == 0, part, 0)
    only = (pieces[owner] == 1) & (parts == 0)
    base = first[0]
    yield emit([c[base : last[-1]] for c in columns], first - base, last - base, parts, only)
