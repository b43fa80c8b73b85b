import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lanewright.llm import pairs, purchases, quantiles, sequences, splits
from tests.conftest import rows

BUYS = "match_id long, player_slot int, account_id long, hero_id int, item_id long, buy_time_s double, buy_index int, n long"


def table(spark, data):
    return spark.createDataFrame([(*r, 0) for r in data], BUYS)


def made(seed=0, seats=120):
    rng = random.Random(seed)
    out = []
    for m in range(seats):
        items = [rng.choice([1, 2, 3, 4, 5_000_000_000]) for _ in range(rng.randrange(0, 9))]
        if m % 3 == 0:
            items = [1, rng.choice([9, 4]), 2, 1]
        for i, x in enumerate(items):
            row = (m // 2, m % 2, rng.choice([None, 0, 1 + m % 17]), rng.choice([7, 8, None]), x if rng.random() > 0.05 else None, float(rng.randrange(60)) if rng.random() > 0.05 else None, i)
            out += [row] * rng.choice([1, 1, 2])
    out += [(None, 1, 1, 7, 1, 1.0, 0), (5, None, 1, 7, 1, 1.0, 0)]
    rng.shuffle(out)
    return out


def seats_of(data):
    once = {}
    for m, s, _, _, x, t, i in data:
        if None not in (m, s, x, t):
            once[m, s, i] = (t, i, x)
    out = {}
    for (m, s, _), v in once.items():
        out.setdefault((m, s), []).append(v)
    return {k: [x for _, _, x in sorted(v)] for k, v in out.items()}


def holds(seq, pattern):
    it = iter(seq)
    return all(x in it for x in pattern)


def brute(seqs, need):
    level = {(x,) for s in seqs for x in s if sum(x in t for t in seqs) >= need}
    single, every = sorted(level), set(level)
    while level:
        level = {q for p in level for (x,) in single if sum(holds(s, q := (*p, x)) for s in seqs) >= need}
        every |= level
    return every


@pytest.mark.parametrize("chunk,block", [(4096, 100_000), (3, 5)])
def test_patterns_match_brute_force(spark, chunk, block):
    data = made()
    seqs = list(seats_of(data).values())
    packed = sequences.stored(sequences.purchase_sequences(table(spark, data), chunk), "t")
    every, n = sequences.mine(packed, ["match_id", "player_slot"], (10, 100), block)
    assert n == len(seqs) and set(every) == brute(seqs, -(-len(seqs) // 10))
    assert all(every[p] == sum(holds(s, p) for s in seqs) for p in every)


def test_patterns_of_nothing(spark):
    assert sequences.frequent_orders(table(spark, [])).count() == 0


def test_packing_streams_long_runs(spark):
    df = spark.createDataFrame([(k, i) for k in range(3) for i in range(10 * k + 1)], "k long, v long")
    got = purchases.pack_runs(df.repartition("k"), ["k"], ["v"], "v", 4).collect()
    for k in range(3):
        parts = sorted((r["part"], r["run"], r["only"]) for r in got if r["k"] == k)
        assert [x for _, run, _ in parts for x in run] == list(range(10 * k + 1)) and all(len(run) <= 4 for _, run, _ in parts)
        assert [p for p, _, _ in parts] == list(range(len(parts))) and all(o == (len(parts) == 1) for _, _, o in parts)


@pytest.mark.parametrize("chunk", [512, 2, 1])
def test_pairs_match_brute_force(spark, chunk):
    data = made(1)
    got = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in pairs.associations(table(spark, data), ["match_id", "player_slot"], "item_id", 1, chunk).collect()}
    baskets = {}
    for m, s, _, _, x, _, _ in data:
        if None not in (m, s, x):
            baskets.setdefault((m, s), set()).add(x)
    alone = lambda x: sum(x in b for b in baskets.values())
    want = {}
    for b in baskets.values():
        for p in combinations(sorted(b), 2):
            want[p] = want.get(p, 0) + 1
    assert got == {p: (n, alone(p[0]), alone(p[1]), len(baskets)) for p, n in want.items()}
    assert pairs.bought_together(table(spark, []), 1).count() == 0


def test_percentiles_keep_their_bound(spark):
    rng = random.Random(2)
    values = [rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 6) for _ in range(2000)] + [0.0] * 50
    df = spark.createDataFrame([(i % 3 or None, v) for i, v in enumerate(values)] + [(1, None), (1, float("nan")), (9, None)], "g int, v double")
    whole = quantiles.sketch(df, ["g"], "v", 0.01)
    halves = [quantiles.sketch(df.where(F.pmod(F.xxhash64("v"), F.lit(2)) == h), ["g"], "v", 0.01) for h in (0, 1)]
    assert rows(quantiles.merge(*halves), "g", "bucket", "n") == rows(whole, "g", "bucket", "n")
    for r in quantiles.percentiles(whole, ["g"], [0.0, 0.1, 0.5, 0.99, 1.0]).collect():
        own = sorted(v for i, v in enumerate(values) if (i % 3 or None) == r["g"])
        exact = own[max(1, -(-int(r["share"] * 1000) * len(own) // 1000)) - 1]
        assert abs(r["value"] - exact) <= 0.0100001 * abs(exact) and r["n_group"] == len(own)
    assert 9 not in {r["g"] for r in whole.collect()}


def test_slow_groups_match_brute_force(spark):
    rng = random.Random(3)
    data = [(m, 1, 1, rng.choice([1, 2, 3, None]), rng.choice([5, 6]), None, m) for m in range(400)]
    data = [(m, s, a, h, x, float(rng.randrange(1, 40)) * (4.2 if h == 1 and x == 5 else 1), i) for m, s, a, h, x, _, i in data]
    lower = lambda v: sorted(v)[(len(v) + 1) // 2 - 1]
    want = set()
    for x in (5, 6):
        every = [r[5] for r in data if r[4] == x]
        for h in (1, 2, 3):
            own = [r[5] for r in data if r[4] == x and r[3] == h]
            if len(own) >= 10 and lower(own) >= 1.5 * lower(every):
                want.add((h, x))
    assert want and set(rows(quantiles.slow_groups(table(spark, data * 2), 1.5))) == want
    assert quantiles.slow_groups(table(spark, [])).count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(4)
    for edges in ([(i, i + 1) for i in range(200)], [(rng.randrange(300), rng.randrange(300)) for _ in range(180)], [(0, i) for i in range(1, 100)], []):
        up = {i: i for i in range(301)}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        e = spark.createDataFrame([*edges, (None, 3), (5, 5)], "u long, v long")
        got = {r["node"]: r["group"] for r in splits.components(spark.range(301).withColumnRenamed("id", "node"), e).collect()}
        assert got == {i: find(i) for i in range(301)}


def test_splits_keep_accounts_together(spark):
    rng = random.Random(5)
    data = [(m, s, rng.choice([None, 0, 1000 + m // 3 if rng.random() < 0.3 else 5000 + m * 12 + s]), 7, 1, 1.0, 0) for m in range(300) for s in range(4)]
    got = splits.match_splits(table(spark, data), {"train": 0.7, "validation": 0.2, "test": 0.1})
    side = {r["match_id"]: r["split"] for r in got.collect()}
    assert len(side) == 300 and len({side[m] for m in side}) == 3
    by = {}
    for m, _, a, *_ in data:
        if a:
            by.setdefault(a, set()).add(side[m])
    assert all(len(s) == 1 for s in by.values())
    sizes = {s: sum(r["n_rows"] for r in got.collect() if r["split"] == s) for s in ("train", "validation", "test")}
    assert abs(sizes["validation"] - 240) <= 4 and abs(sizes["test"] - 120) <= 4
    assert splits.match_groups(table(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_subset_sums_are_closest(seed):
    rng = random.Random(seed)
    sizes = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(5)}
    reach = {0}
    for s, n in sizes.items():
        reach = {r + s * k for r in reach for k in range(n + 1)}
    for target in (0, 7, 33, sum(s * n for s, n in sizes.items()) // 2):
        taken = splits.closest_subset(sizes, target)
        total = sum(s * n for s, n in taken.items())
        assert all(n <= sizes[s] for s, n in taken.items()) and abs(total - target) == min(abs(r - target) for r in reach)


@pytest.mark.parametrize("lo,hi,count", [(100, 500, 10_000), (160, 360, 19_000), (160, 560, 2_000)])
def test_large_splits_meet_their_target(lo, hi, count):
    sizes = {s: count for s in range(lo, hi)}
    rows = sum(s * n for s, n in sizes.items())
    for giant in ({}, {9 * rows: 1}):
        taken = splits.closest_subset(sizes | giant, rows // 10)
        assert all(n <= count for n in taken.values()) and sum(s * n for s, n in taken.items()) == rows // 10


@pytest.mark.parametrize("seed", range(6))
def test_subset_sums_stay_closest_beyond_the_kept_bits(seed, monkeypatch):
    monkeypatch.setattr(splits, "BITS", 300)
    monkeypatch.setattr(splits, "NEAR", 16, raising=False)
    rng = random.Random(seed)
    for step in (1, 1, 4, 6):
        sizes = {rng.randrange(1, 60) * step: rng.randrange(1, 5) for _ in range(6)} | {9000: 1}
        reach = {0}
        for s, n in sizes.items():
            reach = {r + s * k for r in reach for k in range(n + 1)}
        for target in (0, 1, 7, 33, 101, 150, 5000, sum(s * n for s, n in sizes.items()) // 10):
            taken = splits.closest_subset(sizes, target)
            total = sum(s * n for s, n in taken.items())
            assert all(n <= sizes[s] for s, n in taken.items())
            assert total == min(reach, key=lambda r: (abs(r - target), r))


def test_a_repeat_with_another_time_is_no_value(spark):
    # purchase 0 counts with its smallest time, 1.0; its repeat lies in the median bucket of the rest
    data = [(m, 1, 1, 7, 5, 100.0 + m / 100, 0) for m in range(20)] + [(m, 1, 1, 8, 5, 50.0, 0) for m in range(100, 140)]
    data += [(200, 1, 1, 7, 5, 1.0, 0), *[(200, 1, 1, 7, 5, 100.0 + k / 1000, 0) for k in range(12)]]
    own, every = sorted([*(100.0 + m / 100 for m in range(20)), 1.0]), sorted([*(100.0 + m / 100 for m in range(20)), 1.0, *[50.0] * 40])
    assert own[10] >= 2 * every[30]
    assert rows(quantiles.slow_groups(table(spark, data))) == [(7, 5)]


def test_bounds_settle_all_but_close_groups(spark):
    data = [(m, 1, 1, 1, 5, 10.0, 0) for m in range(100)] + [(m, 2, 1, 2, 5, 90.0, 0) for m in range(20)] + [(m, 3, 1, 3, 5, 20.0, 0) for m in range(20)] + [(m, 4, 1, 4, 5, 19.99, 0) for m in range(20)]
    by_group = quantiles.sketch(table(spark, data), ["hero_id", "item_id"], "buy_time_s")
    told = {r["hero_id"]: r["settled"] for r in quantiles.bounded_medians(by_group, 2.0, 10, 0.01).collect()}
    assert told == {2: True, 3: False, 4: False}
    assert rows(quantiles.slow_groups(table(spark, data))) == [(2, 5), (3, 5)]


def test_a_huge_basket_is_spread_over_tasks(spark):
    n = 20_000
    data = spark.range(2 * n).select(F.lit(1).cast("long").alias("match_id"), F.lit(0).alias("player_slot"), (F.col("id") % n).alias("item_id"))
    data = data.unionByName(spark.createDataFrame([(2, 0, 3), (2, 0, 5), (3, 0, 5), (3, 0, 3)], "match_id long, player_slot int, item_id long"))
    keys = ["match_id", "player_slot"]
    packed, split = pairs.baskets(data, keys, "item_id", 512)
    parts = {r["part"]: r["count"] for r in split.groupBy("part").count().collect()}
    assert len(parts) == 40 and sum(parts.values()) == n and max(parts.values()) < 700
    sent = pairs.chunk_products(split, keys).repartition(64, *keys, "low", "high").groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(sent) > 50 and max(r["n"] for r in sent) < 5 * 40 * n / 64
    assert packed.count() == 2


def test_a_huge_basket_has_all_pairs(spark):
    n = 1500
    data = spark.range(2 * n).select(F.lit(1).cast("long").alias("match_id"), F.lit(0).alias("player_slot"), (F.col("id") % n).alias("item_id"))
    got = pairs.associations(data.unionByName(spark.createDataFrame([(2, 0, 3), (2, 0, 5)], "match_id long, player_slot int, item_id long")), ["match_id", "player_slot"], "item_id", 1, 200)
    told = got.agg(F.count(F.lit(1)), F.sum("n_ab"), F.max("n_ab"), F.max("n"), F.sum((F.col("item_a") >= F.col("item_b")).cast("int"))).first()
    assert tuple(told) == (n * (n - 1) // 2, n * (n - 1) // 2 + 1, 2, 2, 0)
