"""Splits that keep related records together.

Records that share an entity (a match, an account) belong to one component.
Components come from rounds of hooking and shortcutting over parent tables:
each node hooks to its smallest smaller neighbour, pointer jumps halve the
parents' paths until every parent is a root, and the edges are renamed to the
roots.  Only nodes without a smaller neighbour stay, so each round leaves at
most half of the nodes, and a path of any length takes one round.  A node's
component is the composition of the rounds' roots and is the smallest node
tied to it.  Every table is written to the shared folder, so
lineage stays short; nothing per node or per edge reaches the driver.

Splits: the driver sees only the histogram of component sizes.  A bitset of
reachable totals over (size, multiplicity) finds, for each held-out share, the
reachable total closest to its target; components of equal size are then dealt
by their rank within the size, which is computed in buckets.

Defined results: account null or 0 ties nothing; a match without such a tie is
its own component; rows without match_id are in no component; repeated rows
change no component but count towards its size; an empty table gives no rows.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewright.runtime import stored

#: Bits that all kept bitsets of one target may take together (one bitset at least); steps are repeated beyond.
BITS = 1 << 30
#: Rows short of the target up to which large cases take the largest components before the search.
NEAR = 1 << 20


def account_edges(purchases: DataFrame) -> DataFrame:
    """(u, v), u > v: each match of an account with the account's smallest match."""
    ties = purchases.select("match_id", "account_id").where(F.col("match_id").isNotNull() & F.col("account_id").isNotNull() & (F.col("account_id") != 0)).distinct()
    ties = stored(ties, "ties")
    least = ties.groupBy("account_id").agg(F.min("match_id").alias("v"), F.max("match_id").alias("most")).where(F.col("v") < F.col("most")).drop("most")
    return ties.join(least, "account_id").where(F.col("match_id") > F.col("v")).select(F.col("match_id").alias("u"), "v")


def _shortcut(parents: DataFrame) -> DataFrame:
    """Every node's root: pointers jump, which halves all paths, until no parent has a parent."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = parents.select("node", "parent").join(up, "parent", "left")
        parents = stored(jumped.select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")), "parents")
        if parents.where("moved").isEmpty():
            return parents.select("node", "parent")


def _renamed(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges between parents, loops and repeats dropped, the larger end first."""
    for end in ("u", "v"):
        side = parents.select(F.col("node").alias(end), F.col("parent").alias(f"to_{end}"))
        edges = edges.join(side, end, "left").withColumn(end, F.coalesce(f"to_{end}", end)).select("u", "v")
    return edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, group): the smallest node tied to each node of ``nodes`` (distinct, not null).

    ``edges`` (u, v) may hold repeats and loops; ends that are null tie nothing.
    """
    known = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    left = stored(known.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    rounds = []
    while not left.isEmpty():
        hooks = left.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("parent"))
        parents = _shortcut(stored(hooks, "hooks"))
        rounds.append(parents)
        left = stored(_renamed(left, parents), "edges")
    labels = nodes.select(F.col(node).alias("node"), F.col(node).alias("group"))
    for parents in rounds:
        side = parents.select(F.col("node").alias("group"), "parent")
        labels = labels.join(side, "group", "left").select("node", F.coalesce("parent", "group").alias("group"))
    return labels


def match_groups(purchases: DataFrame) -> DataFrame:
    """(match_id, group_id), one row per match."""
    matches = purchases.select("match_id").where(F.col("match_id").isNotNull()).distinct()
    return components(matches, account_edges(purchases), "match_id").select(F.col("node").alias("match_id"), F.col("group").alias("group_id"))


def closest_subset(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many components of each size to take so that their total comes closest
    to ``target`` (the smaller total on a tie).

    Large cases first take the largest components up to ``NEAR`` of the target and
    search only the rest; what hits the target that way is closest.  If nothing
    does, all is searched: the result is exact at every size."""
    if target * sum(count.bit_length() for count in sizes.values()) > BITS:
        bulk, rest, left = {}, dict(sizes), target
        for size in sorted(sizes, reverse=True):
            if n := min(sizes[size], max(0, left - NEAR) // size):
                bulk[size] = n
                rest[size] -= n
                left -= n * size
        near = _closest(rest, left)
        if sum(size * n for size, n in near.items()) == left:
            return {size: bulk.get(size, 0) + near.get(size, 0) for size in bulk.keys() | near.keys()}
    return _closest(sizes, target)


def _closest(sizes: dict[int, int], target: int) -> dict[int, int]:
    """``closest_subset`` by one bitset of reachable totals, in units of the sizes' common divisor."""
    # a component of twice the target lies no closer than nothing
    sizes = {size: count for size, count in sizes.items() if count and size < 2 * target}
    if not sizes:
        return {}
    unit = gcd(*sizes)
    below, over = divmod(target, unit)
    goal = below + (2 * over > unit)
    lots = [(size // unit, take) for size, count in sorted(sizes.items(), reverse=True) for take in _powers(count)]
    mask = (1 << (min(2 * target, target + max(sizes)) // unit + 1)) - 1
    reach, n = 1, 0
    while n < len(lots) and not reach >> goal & 1:
        reach = _with(reach, lots[n], mask)
        n += 1
    total = goal
    if not reach >> goal & 1:
        total = (reach & ((1 << (below + 1)) - 1)).bit_length() - 1
        if above := reach >> (below + 1):
            high = below + (above & -above).bit_length()
            total = total if target - total * unit <= high * unit - target else high
    del reach
    taken: dict[int, int] = {}
    for size, take in _traced(1, lots[:n], total):
        taken[size * unit] = taken.get(size * unit, 0) + take
    return taken


def _with(reach: int, lot: tuple[int, int], mask: int) -> int:
    return reach | (reach << (lot[0] * lot[1])) & mask


def _traced(reach: int, lots: list[tuple[int, int]], total: int) -> list[tuple[int, int]]:
    """The lots that lead from ``reach`` to ``total``.  Bitsets of as many lots as fit into ``BITS``
    are kept; longer lists are halved, which repeats steps instead."""
    mask = (1 << (total + 1)) - 1
    reach &= mask
    if len(lots) > max(1, BITS // (total + 1)):
        half = len(lots) // 2
        middle = reach
        for lot in lots[:half]:
            middle = _with(middle, lot, mask)
        late = _traced(middle, lots[half:], total)
        del middle
        return late + _traced(reach, lots[:half], total - sum(size * take for size, take in late))
    kept = []
    for lot in lots:
        kept.append(reach)
        reach = _with(reach, lot, mask)
    out = []
    for lot, before in zip(reversed(lots), reversed(kept)):
        if not before >> total & 1:
            out.append(lot)
            total -= lot[0] * lot[1]
    return out


def _powers(count: int) -> list[int]:
    """1, 2, 4, ... and a rest, that sum to ``count``."""
    out, k = [], 1
    while count > 0:
        out.append(min(k, count))
        count -= out[-1]
        k *= 2
    return out


def assign_splits(groups: DataFrame, shares: dict[str, float], salt: int = 0) -> DataFrame:
    """(group_id, size, split) of ``groups`` (group_id, size); the first split takes what the others leave."""
    histogram = {r["size"]: r["count"] for r in groups.groupBy("size").count().collect()}  # at most sqrt(2 * rows) sizes
    names = list(shares)
    total = sum(size * count for size, count in histogram.items())
    left, quota = dict(histogram), {}
    for name in names[1:]:
        quota[name] = closest_subset(left, round(total * shares[name]))
        left = {size: count - quota[name].get(size, 0) for size, count in left.items() if count > quota[name].get(size, 0)}
    rows, begin = [], {}
    for name in names[1:]:
        for size, count in quota[name].items():
            first = begin.get(size, 0)
            rows.append((size, first, first + count, name))
            begin[size] = first + count
    spans = groups.sparkSession.createDataFrame(rows, "size long, first long, after long, split string")
    # the rank within a size, in buckets, so that no task holds all components of a size
    dealt = groups.withColumn("key", F.xxhash64("group_id", F.lit(salt))).withColumn("bucket", F.pmod("key", F.lit(1024)))
    counts = dealt.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("size", "bucket", (F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = dealt.join(before, ["size", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("size", "bucket").orderBy("key", "group_id")) - 1)
    inside = (ranked["size"] == spans["size"]) & (ranked["rank"] >= spans["first"]) & (ranked["rank"] < spans["after"])
    return ranked.join(spans, inside, "left").select("group_id", ranked["size"], F.coalesce(spans["split"], F.lit(names[0])).alias("split"))


def match_splits(purchases: DataFrame, shares: dict[str, float] | None = None, salt: int = 0) -> DataFrame:
    """(match_id, group_id, n_rows, split): no account and no match is on two sides; shares count purchase rows."""
    labels = stored(match_groups(purchases), "labels")
    rows = purchases.where(F.col("match_id").isNotNull()).groupBy("match_id").agg(F.count(F.lit(1)).alias("n_rows"))
    labelled = labels.join(rows, "match_id")
    groups = stored(labelled.groupBy("group_id").agg(F.sum("n_rows").alias("size")), "groups")
    return labelled.join(assign_splits(groups, shares or {"train": 0.8, "validation": 0.1, "test": 0.1}, salt).drop("size"), "group_id").select("match_id", "group_id", "n_rows", "split")
