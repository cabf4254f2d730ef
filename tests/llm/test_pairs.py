import math
import random
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedloop.llm import cooccur, simjoin, topn
from feedloop.llm.cooccur import associations, baskets, item_counts
from feedloop.llm.packed import merge_runs, pack, run_lengths, unpack
from feedloop.llm.simjoin import merge_skip, similar_pairs
from feedloop.llm.topn import survivors, top_n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=50), st.integers(1, 4))
def test_packed_runs(codes, parts):
    runs = [run_lengths(np.array(codes[k::parts], np.int64)) for k in range(parts)]
    keys, counts = merge_runs(runs)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {c: codes.count(c) for c in codes}
    assert [a.tolist() for a in unpack(pack(keys, counts), 2)] == [keys.tolist(), counts.tolist()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 25), max_size=12), min_size=1, max_size=8), st.integers(1, 6))
def test_merge_skip(lists, least):
    lists = [sorted(set(x)) for x in lists]
    count = {k: sum(k in x for x in lists) for x in lists for k in x}
    assert dict(merge_skip(lists, [0] * len(lists), least)) == {k: n for k, n in count.items() if n >= least}


def _ratings(seed, users=60, items=25, n=900):
    rnd = random.Random(seed)
    rows = [(rnd.randint(0, users), min(int(rnd.expovariate(0.12)), items), rnd.choice([3.0, 4.0, 5.0]), "x") for _ in range(n)]
    rows += [(k, i, 5.0, "x") for k in (100, 101, 102) for i in range(8)]  # equal sets
    rows += [(200 + k, i, 5.0, "x") for k in range(3) for i in range(30, 41 + k)]
    rows += [(7, 3, 4.0, "x")] * (n // 2)  # one user and item with a third of all rows
    rows += [(None, 3, 4.0, "x"), (3, None, 4.0, "x"), (None, None, None, None), (300, None, 5.0, "x")]
    rnd.shuffle(rows)
    return rows


SCHEMA = "u int, i int, v double, a string"


def _sets(rows):
    out = {}
    for u, i, *_ in rows:
        if u is not None and i is not None:
            out.setdefault(u, set()).add(i)
    return out


@pytest.mark.parametrize("threshold", [Fraction(7, 10), Fraction(1, 2), Fraction(1), Fraction(9, 10)])
@pytest.mark.parametrize("block", [4000, 6])
def test_similar_pairs(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(simjoin, "BLOCK", block)  # a small block cuts every crowded partition
    rows = _ratings(1)
    sets = {u: s for u, s in _sets(rows).items() if len(s) >= 3}
    expected = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in similar_pairs(df, "u", "i", threshold, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and (100, 101) in expected


def test_similar_pairs_of_nothing(spark):
    assert similar_pairs(spark.createDataFrame([], SCHEMA), "u", "i", Fraction(7, 10)).count() == 0
    nulls = spark.createDataFrame([(None, 1, 1.0, "x"), (1, None, 1.0, "x")], SCHEMA)
    assert similar_pairs(nulls, "u", "i", Fraction(7, 10)).count() == 0


@pytest.mark.parametrize("held", [8_000_000, 5])
def test_associations(spark, monkeypatch, held):
    monkeypatch.setattr(cooccur, "HELD", held)  # a small store spills runs to the shuffle
    monkeypatch.setattr(cooccur, "BLOCK", 40 if held == 5 else 4_000_000)
    rows = _ratings(2)
    sets = _sets(rows)
    n = len({u for u, *_ in rows if u is not None})
    count = {i: sum(i in s for s in sets.values()) for s in sets.values() for i in s}
    pairs = {}
    for s in sets.values():
        for a, b in combinations(sorted(s), 2):
            pairs[a, b] = pairs.get((a, b), 0) + 1
    got = {(r["a"], r["b"]): r for r in associations(spark.createDataFrame(rows, SCHEMA), "u", "i").collect()}
    assert set(got) == set(pairs)
    for (a, b), k in pairs.items():
        r, x, y = got[a, b], count[a], count[b]
        assert (r["n_ab"], r["n_a"], r["n_b"], r["n"]) == (k, x, y, n)
        assert r["lift"] == pytest.approx(k * n / (x * y))
        assert r["log_odds"] == pytest.approx(math.log((k + 0.5) * (n - x - y + k + 0.5) / ((x - k + 0.5) * (y - k + 0.5))))


def test_associations_edges(spark):
    assert associations(spark.createDataFrame([], SCHEMA), "u", "i").count() == 0
    one = spark.createDataFrame([(1, 5, 1.0, "x"), (1, 5, 1.0, "x")], SCHEMA)
    assert associations(one, "u", "i").count() == 0 and item_counts(baskets(one, "u", "i")).collect()[0]["n_item"] == 1
    far = spark.createDataFrame([(1, 0), (1, 2**31 - 1)], "u int, i int")
    assert [tuple(r)[:3] for r in associations(far, "u", "i").collect()] == [(0, 2**31 - 1, 1)]
    with pytest.raises(Exception, match="codes must lie"):
        baskets(spark.createDataFrame([(1, -1)], "u int, i int"), "u", "i").count()
    with pytest.raises(TypeError):
        baskets(spark.createDataFrame([("a", 1)], "u string, i int"), "u", "i")


@pytest.mark.parametrize("block", [1_500_000, 50])
def test_top_n(spark, monkeypatch, block):
    monkeypatch.setattr(topn, "BLOCK", block)
    rows = _ratings(3, users=8, items=300, n=2500) + [(1, 2, float("nan"), "x"), (1, 3, None, "x")]
    best = {}
    for u, i, v, _ in rows:
        if u is not None and i is not None and v is not None and v == v:
            best[u, i] = max(v, best.get((u, i), v))
    expected = set()
    for u in {k[0] for k in best}:
        order = sorted((-v, i) for (w, i), v in best.items() if w == u)
        expected |= {(u, i, -v, k) for k, (v, i) in enumerate(order[:5], 1)}
    got = {tuple(r) for r in top_n(spark.createDataFrame(rows, SCHEMA).repartition(4), "u", "i", "v", 5).collect()}
    assert got == expected


def test_top_n_edges(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), "u", "i", "v", 5).count() == 0
    with pytest.raises(TypeError):
        top_n(spark.createDataFrame([("a", 1, 1.0)], "u string, i int, v double"), "u", "i", "v", 5)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(0, 2**32 - 1), st.integers(1, 400), st.integers(1, 40))
def test_the_threshold_is_safe(n, seed, rows, values):
    rng = np.random.default_rng(seed)
    item = rng.permutation(10 * rows)[:rows]
    group, score = rng.integers(0, 3, rows), rng.integers(0, values, rows) / 2
    keep = set(survivors(group, item, score, n).tolist())
    for g in range(3):
        own = np.flatnonzero(group == g)
        first = own[np.lexsort((item[own], -score[own]))][:n]
        assert set(first.tolist()) <= keep


def test_the_threshold_drops_rows_of_large_groups():
    item = np.arange(100_000)
    assert len(survivors(np.zeros(100_000, int), item, np.full(100_000, 5.0), 5)) < 3_000
    assert len(survivors(np.zeros(100_000, int), item, np.random.default_rng(0).random(100_000), 5)) < 3_000


def test_a_large_record_is_cut_to_slices(spark):
    m = cooccur.LARGE + 900
    df = spark.createDataFrame([(1, i) for i in range(m)] + [(2, i) for i in range(0, m, 2)] + [(3, None), (4, 7)], "u int, i int")
    blocks = baskets(df, "u", "i", bare=True)
    slices = blocks.where("sliced").collect()
    assert len(slices) >= 3 and all(r["high"] > r["low"] for r in slices)
    every, even = m * (m - 1) // 2, (m // 2) * (m // 2 - 1) // 2
    assert cooccur.size_of(blocks) == (4, every + even)
    counts = {(r["n_ab"], r["n"]): r["c"] for r in associations(df, "u", "i").groupBy("n_ab", "n").agg(F.count("*").alias("c")).collect()}
    assert counts == {(1, 4): every - even, (2, 4): even}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12), st.integers(2, 12), st.integers(1, 30), st.integers(5, 60))
def test_slices_hold_each_pair_once(sizes, large, row, block):
    code = np.concatenate([(np.int64(u) << 32) | np.arange(0, 2 * n, 2) for u, n in enumerate(sizes)])
    saved = cooccur.LARGE, cooccur.ROW, cooccur.BLOCK
    cooccur.LARGE, cooccur.ROW, cooccur.BLOCK = large, row, block
    try:
        got = [int(p) for b in cooccur._rows(code) for part, low, high in cooccur._slices_of(iter([b])) for pairs in cooccur._pair_codes(part, low, high) for p in pairs]
    finally:
        cooccur.LARGE, cooccur.ROW, cooccur.BLOCK = saved
    pairs = sorted(tuple(int(x) for x in ab) for ab in zip(*cooccur._unpair(np.array(got, np.int64)), strict=True))
    assert pairs == sorted((2 * a, 2 * b) for n in sizes for a, b in combinations(range(n), 2))


def test_runs_are_merged_as_streams(monkeypatch):
    """What lies below the first codes of all pieces to come is given out: little is held, however long the runs are."""
    monkeypatch.setattr(cooccur, "HELD", 4000)
    rng = np.random.default_rng(0)
    runs = [run_lengths(np.sort(rng.integers(0, 1 << 40, 100_000))) for _ in range(8)]
    pieces = sorted((int(c[k]), c[k : k + 500], n[k : k + 500]) for c, n in runs for k in range(0, len(c), 500))
    merge, out, most = cooccur._Merge(1), 0, 0
    for first, codes, counts in pieces:
        out += sum(b.num_rows for b in merge.add(first, (codes, counts)))
        most = max(most, merge.held)
    out += sum(b.num_rows for b in merge.rest())
    assert out == len(np.unique(np.concatenate([c for c, _ in runs]))) and most < 20_000


@pytest.mark.parametrize("share", [2_000, 1])
def test_a_large_class_of_equal_sets(spark, monkeypatch, share):
    monkeypatch.setattr(simjoin, "SHARE", share)
    rows = [(u, i) for u in range(30) for i in range(10)] + [(u, i) for u in range(40, 43) for i in range(11)] + [(50, i) for i in range(20, 30)]
    got = [tuple(r) for r in similar_pairs(spark.createDataFrame(rows, "u int, i int"), "u", "i", Fraction(7, 10), 5).collect()]
    assert len(got) == len(set(got)) and set(got) == set(combinations([*range(30), *range(40, 43)], 2))


def test_few_rows_of_a_spread_group_reach_the_rank(spark):
    """A group whose rows lie in many partitions: the greatest of its thresholds drops nearly all of them."""
    df = spark.range(0, 400_000, numPartitions=50).select(F.lit(1).alias("g"), F.col("id").alias("i"), (F.hash("id") % 100_000).cast("double").alias("s"), F.lit("x").alias("_s"))
    df = df.unionByName(spark.createDataFrame([(1, -1, 1e12, "x"), (2, 5, float("-inf"), "x")], "g int, i bigint, s double, _s string"))  # outliers
    rows = df.select(F.col("g").cast("bigint").alias("_g"), F.col("i").alias("_i"), F.col("s").alias("_s"))
    given = topn._thresholds(rows, 5)
    assert given.value[0].tolist() == [1]
    left = topn._in_blocks(rows, lambda g, i, s: topn._above(given, g, i, s), "_g bigint, _i bigint, _s double").where("_g = 1").count()
    assert 5 <= left <= 200
    got = [(r["i"], r["s"]) for r in top_n(df, "g", "i", "s", 5).where("g = 1").orderBy("rank").collect()]
    assert got == [(r["i"], r["s"]) for r in df.where("g = 1").orderBy(F.desc("s"), "i").limit(5).collect()]
