"""Top N items within every group: score histograms, a safe threshold, and an exact rank of what is left.

1. In each input partition, items are taken once per group with their best score, and every group that is large there
   gets a histogram of its scores. Counting down from the best bin until N items are reached leaves few rows, and the
   N-th best of them is a threshold: N different items of the group are at least as good.
2. Each of a group's thresholds is safe for the whole group, so the greatest of them is given out to all partitions.
3. Rows below their group's threshold are dropped before the shuffle. Where a histogram's own bin is crowded (equal
   scores), it is split the same way by the tie key. What is left is ranked exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 64
#: Rows that a task looks at together; a bound on its memory, not on the result.
BLOCK = 1_500_000
#: A group with at most so many times N items in a block is passed on as it is.
SLACK = 4
#: Groups whose thresholds are given out (24 bytes each), those with most rows. Of further groups each block drops rows
#: by its own threshold only; the result is the same.
GIVEN_OUT = 200_000


def _bins(x: np.ndarray) -> np.ndarray:
    """x, smaller is better, in at most BINS steps that hold about as many values each; keeps the order, and equal values together."""
    at = np.unique(np.linspace(0, len(x) - 1, BINS).astype(np.int64))
    edges = np.unique(np.partition(x, at)[at])
    return np.searchsorted(edges, x, "left").astype(np.int64)


def survivors(group: np.ndarray, item: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Places of the rows that may be among the first n of their group; (group, item) must be distinct."""
    keep = np.ones(len(group), bool)
    codes, at, size = np.unique(group, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(size[at] > SLACK * n)
    need = np.full(len(codes), n)
    for key in (-score, item.astype(np.float64)):
        if not len(rows):
            break
        big, g = np.unique(at[rows], return_inverse=True)
        b = _bins(key[rows])
        up_to = np.bincount(g * (BINS + 1) + b, minlength=len(big) * (BINS + 1)).reshape(-1, BINS + 1).cumsum(axis=1)
        last = (up_to >= need[big][:, None]).argmax(axis=1)
        keep[rows[b > last[g]]] = False
        need[big] -= np.where(last > 0, up_to[np.arange(len(big)), np.maximum(last - 1, 0)], 0)
        edge = b == last[g]
        crowd = np.bincount(g[edge], minlength=len(big))
        rows = rows[edge & (crowd[g] > SLACK * need[big][g])]
        if key is not item and len(rows):
            # Only rows of equal score may be told apart by the tie key: a bin that mixes scores stays whole.
            low = np.full(len(codes), np.inf)
            high = np.full(len(codes), -np.inf)
            np.minimum.at(low, at[rows], score[rows])
            np.maximum.at(high, at[rows], score[rows])
            rows = rows[low[at[rows]] == high[at[rows]]]
    return np.flatnonzero(keep)


def _thin(g: np.ndarray, i: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(group, item, score) of the block's rows that may be among their group's first n, each item once, and how many items the row's group has here."""
    order = np.lexsort((-s, i, g))
    g, i, s = g[order], i[order], s[order]
    first = np.concatenate((np.ones(min(1, len(g)), bool), (g[1:] != g[:-1]) | (i[1:] != i[:-1])))
    g, i, s = g[first], i[first], s[first]
    at = survivors(g, i, s, n)
    _, place, size = np.unique(g, return_inverse=True, return_counts=True)
    return g[at], i[at], s[at], size[place[at]]


def _worst(g: np.ndarray, i: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(group, item, score, items) of the n-th best row of each group that is large in the block."""
    g, i, s, size = _thin(g, i, s, n)
    large = size > SLACK * n
    g, i, s, size = g[large], i[large], s[large], size[large]
    order = np.lexsort((i, -s, g))
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), g[order][1:] != g[order][:-1])))
    at = order[start + n - 1]
    return g[at], i[at], s[at], size[at]


def _in_blocks(rows: DataFrame, work: Callable[..., tuple[np.ndarray, ...]], schema: str) -> DataFrame:
    """work(group, item, score) of each block of rows of a task."""
    names = [c.split()[0] for c in schema.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c) for c in work(*(np.concatenate(c) for c in zip(*held, strict=True)))], names=names)

        for b in batches:
            if b.num_rows:
                held.append([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
                count += b.num_rows
            if count >= BLOCK:
                yield done()
                held, count = [], 0
        if held:
            yield done()

    return rows.mapInArrow(kernel, schema)


def _thresholds(rows: DataFrame, n: int) -> Broadcast:
    """(groups, items, scores) of the greatest threshold that a block found for each group, groups ascending."""
    found = _in_blocks(rows, lambda g, i, s: _worst(g, i, s, n), "_g bigint, _i bigint, _s double, _n bigint")
    best = F.max(F.struct("_s", F.bitwise_not("_i").alias("_not")))
    per = found.groupBy("_g").agg(best.alias("_t"), F.sum("_n").alias("_n")).orderBy(F.desc("_n"), "_g").limit(GIVEN_OUT)
    table = sorted((r["_g"], ~r["_t"]["_not"], r["_t"]["_s"]) for r in per.collect())
    g, i, s = zip(*table, strict=True) if table else ((), (), ())
    return rows.sparkSession.sparkContext.broadcast((np.array(g, np.int64), np.array(i, np.int64), np.array(s, float)))


def _above(given: Broadcast, g: np.ndarray, i: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows that aren't below their group's threshold."""
    groups, items, scores = given.value
    if not len(groups):
        return g, i, s
    at = np.minimum(np.searchsorted(groups, g), len(groups) - 1)
    keep = (groups[at] != g) | (s > scores[at]) | ((s == scores[at]) & (i <= items[at]))
    return g[keep], i[keep], s[keep]


def top_n(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """``(group, item, score, rank)``: the n best items of each group, by score downwards, then by item upwards.

    An item counts once in a group, with its best score. Rows with a null group or item, or a null or NaN score, don't
    count; a group without other rows gives none. Groups with fewer than n items give all. The order is total, so the
    result is the same on every run. group and item must be whole numbers. Other columns are ignored.
    """
    for name in (group, item):
        if not isinstance(df.schema[name].dataType, T.IntegralType):
            raise TypeError(f"{name} must be a whole-number column")
    rows = df.select(F.col(group).cast("bigint").alias("_g"), F.col(item).cast("bigint").alias("_i"), F.col(score).cast("double").alias("_s"))
    rows = rows.where(F.col("_g").isNotNull() & F.col("_i").isNotNull() & F.col("_s").isNotNull() & ~F.isnan("_s"))

    given = _thresholds(rows, n)
    best = _in_blocks(rows, lambda g, i, s: _thin(*_above(given, g, i, s), n)[:3], "_g bigint, _i bigint, _s double")
    best = best.repartition("_g").groupBy("_g", "_i").agg(F.max("_s").alias("_s"))
    rank = F.row_number().over(Window.partitionBy("_g").orderBy(F.desc("_s"), F.asc("_i")))
    ranked = best.withColumn("_r", rank).where(F.col("_r") <= n)
    return ranked.select(
        F.col("_g").cast(df.schema[group].dataType).alias(group), F.col("_i").cast(df.schema[item].dataType).alias(item),
        F.col("_s").alias(score), F.col("_r").alias("rank"),
    )
