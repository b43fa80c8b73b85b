"""Evaluation texts inside a training corpus, found with suffix arrays.

Each task builds suffix arrays over shards of its documents' words (only of
stretches of at least ``shared`` words that occur in the test items at all;
others cannot match).  Every suffix of every test item is searched for by
bisection; the suffixes between the two bounds share ``shared`` words with it,
and are extended word by word to the longest verbatim match.  Documents never
move: what leaves a task is one row per document and leaked item.

Test items are sent to the tasks in blocks of at most ``block_chars``
characters, each with a pass of its own, so the broadcast has a fixed bound.

Defined results: words are runs of letters and digits of any script, in lower
case; null, empty and shorter texts match nothing; a repeated document is
reported under each of its ids; items that share a passage are each reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs of letters and digits: word characters without the underscore.
WORD = re.compile(r"[^\W_]+")
#: Words of one shard, and matches of a shard that are extended at a time.
SHARD, HITS = 1_500_000, 2_000_000


def words(text: str) -> list[str]:
    """Lower-case words of a text."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


class TestSet:
    """The items' words as numbers, and all their suffixes of ``shared`` words or more."""

    def __init__(self, items: list[tuple[int, str]], shared: int) -> None:
        self.shared, self.ids = shared, {}
        flat, starts, stops, owner = [0], [], [], []
        for item, text in items:
            row = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text or "")]
            for i in range(len(row) - shared + 1):
                starts.append(len(flat) + i)
                stops.append(len(flat) + len(row))
                owner.append(item)
            flat += [*row, 0]
        self.flat, self.starts, self.stops, self.owner = (np.array(x, np.int64) for x in (flat, starts, stops, owner))


def suffix_array(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the first ``depth`` (or more) words from each, by rank doubling."""
    rank, reach = text, 1
    while reach < depth:
        step = min(reach, depth - reach)
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1]
        reach += step
    return starts[np.argsort(rank[starts], kind="stable")]


def _bound(text: np.ndarray, order: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """Bisection: the first suffix not below (``after``: above) each row of ``wanted``."""
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
    span = np.arange(wanted.shape[1])
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) // 2
        have, want = text[order[mid][:, None] + span], wanted[live]
        differs = have != want
        first = differs.argmax(1)
        row = np.arange(len(live))
        below = differs[row, first] & (have[row, first] < want[row, first])
        if after:
            below |= ~differs[row, first]
        lo[live[below]] = mid[below] + 1
        hi[live[~below]] = mid[~below]


def _extended(tests: TestSet, text: np.ndarray, back: np.ndarray, some: np.ndarray, low: np.ndarray, hits: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(test suffix, place, length in words) of all matches of the suffixes ``some`` that begin where no longer match does."""
    test = np.repeat(some, hits)
    place = order[np.repeat(low, hits) + np.arange(len(test)) - np.repeat(np.cumsum(hits) - hits, hits)]
    before = np.where(place > 0, text[place - 1], 0)
    before = np.where((place > 0) & (back[place] - back[np.maximum(place - 1, 0)] == 1), before, 0)
    first = (before == 0) | (before != tests.flat[tests.starts[test] - 1])  # others start inside a longer match
    test, place = test[first], place[first]
    length = np.full(len(test), tests.shared)
    live = np.arange(len(test))
    while len(live):
        at, of = place[live] + length[live], tests.starts[test[live]] + length[live]
        ok = (of < tests.stops[test[live]]) & (at < len(text))
        live, at, of = live[ok], at[ok], of[ok]
        live = live[(text[at] == tests.flat[of]) & (text[at] > 0)]
        length[live] += 1
    return test, place, length


def _longest(doc: np.ndarray, item: np.ndarray, length: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each document and item the longest match, the first of equal ones."""
    best = np.lexsort((whole, -length, item, doc))
    new = np.ones(len(best), bool)
    new[1:] = (doc[best][1:] != doc[best][:-1]) | (item[best][1:] != item[best][:-1])
    best = best[new]
    return doc[best], item[best], length[best], whole[best]


def _matches(tests: TestSet, docs: list[int], numbers: list[list[int]]) -> pa.RecordBatch | None:
    """One row per document of the shard and item whose texts share enough words."""
    n = tests.shared
    sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
    text = np.zeros(int(sizes.sum()) + len(sizes) + n, np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    for b, row in zip(begin, numbers):
        text[b : b + len(row)] = row
    ends = np.append(np.flatnonzero(text == 0), len(text))
    room = ends[np.searchsorted(ends, np.arange(len(text)))] - np.arange(len(text))
    starts = np.flatnonzero(room >= n)
    if not len(starts) or not len(tests.starts):
        return None
    # keep the stretches that are long enough, each followed by one breaker
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n + 1, -1)
    keep = np.cumsum(step)[:-1] > 0
    back = np.flatnonzero(keep)
    short = np.concatenate([text[keep], np.zeros(n, np.int64)])
    order = suffix_array(short, np.searchsorted(back, starts), n)
    wanted = tests.flat[tests.starts[:, None] + np.arange(n)]
    low, high = _bound(short, order, wanted, False), _bound(short, order, wanted, True)
    hits = high - low
    blocks = np.cumsum(hits) // HITS  # passages that many items and documents share are taken a part at a time
    parts = []
    for block in np.unique(blocks[hits > 0]):
        some = np.flatnonzero((blocks == block) & (hits > 0))
        test, place, length = _extended(tests, short, back, some, low[some], hits[some], order)
        whole = back[place]
        doc = np.searchsorted(begin, whole, side="right") - 1
        parts.append(_longest(doc, tests.owner[test], length, whole))
    if not parts:
        return None
    doc, item, length, whole = _longest(*(np.concatenate(c) for c in zip(*parts)))
    if not len(doc):
        return None
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(docs, np.int64)[doc]), pa.array(item), pa.array(length.astype(np.int32)), pa.array((whole - begin[doc]).astype(np.int64))],
        ["doc_id", "bench_id", "n_words", "doc_word"],
    )


def _searcher(tests_of):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: TestSet = tests_of()
        number = tests.ids.get
        docs: list[int] = []
        rows: list[list[int]] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = [number(w, 0) for w in words(text.as_py())]
                docs.append(doc)
                rows.append(row)
                size += len(row)
                if size >= SHARD:
                    found = _matches(tests, docs, rows)
                    docs, rows, size = [], [], 0
                    if found:
                        yield found
        if docs and (found := _matches(tests, docs, rows)):
            yield found

    return search


def leaks(documents: DataFrame, items: DataFrame, shared: int = 12, block_chars: int = 20_000_000) -> DataFrame:
    """(doc_id, bench_id, n_words, doc_word): the longest stretch of words that each
    document shares with each item, if ``shared`` or more, and where it begins."""
    spark = documents.sparkSession
    known = items.select("bench_id", "text").where(F.col("bench_id").isNotNull() & F.col("text").isNotNull())
    blocks = max(1, -(-(known.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    texts = documents.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * shared - 1))
    found = None
    for block in range(blocks):
        some = known.where(F.pmod(F.xxhash64("bench_id"), F.lit(blocks)) == block).collect()
        tests = spark.sparkContext.broadcast(TestSet([(r["bench_id"], r["text"]) for r in some], shared))
        part = texts.mapInArrow(_searcher(lambda tests=tests: tests.value), "doc_id long, bench_id long, n_words int, doc_word long")
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that hold no leaked passage."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
