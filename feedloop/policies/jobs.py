"""Runs as Spark jobs: one task for each (policy, seed), all runs side by side.

A step of a run depends on the step before, so a run is one task. What it reads is written once to the shared checkpoint folder, and each
run's task streams it from there: rows are neither multiplied by the runs, nor sent through the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloop.policies.loop import Ratings, replay, run
from feedloop.policies.registry import Spec
from feedloop.session import cut

#: Ratings that a closed loop may hold in each task (16 bytes each); more are refused, since every run needs them all at once.
MOST_RATINGS = 50_000_000
RUN_SCHEMA = "run string, seed int, iter int, rank int, u int, i int, value double, time bigint"
#: Rows that a run gives out at a time.
ROWS = 50_000


def side_by_side(rows: DataFrame, specs: list[Spec], seeds: list[int], work: Callable, schema: str) -> DataFrame:
    """The union of work(spec, seed) over the rows, which come sorted by their first column; every run in a task of its own."""
    order = rows.columns[0]
    once = cut(rows.orderBy(order))
    one = once.coalesce(1).sortWithinPartitions(order)  # sorted parts: cheap to merge
    parts = [one.mapInPandas(work(s, seed), schema) for s in specs for seed in seeds]
    return reduce(DataFrame.unionAll, parts) if parts else rows.sparkSession.createDataFrame([], schema)


def _given_out(rows: Iterator[tuple], columns: list[str], spec: Spec, seed: int) -> Iterator[pd.DataFrame]:
    while some := list(islice(rows, ROWS)):
        yield pd.DataFrame(some, columns=columns).assign(run=spec.name, seed=seed)[["run", "seed", *columns]]


def _timed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows with the milliseconds since the row before."""
    began = time.perf_counter()
    for row in rows:
        now = time.perf_counter()
        yield *row, int((now - began) * 1000)
        began = now


def simulate(
    ratings: DataFrame, specs: list[Spec], seeds: list[int], limit: float, n_users: int, n_items: int, threshold: float = 0.5, ties: str = "random", stored: DataFrame | None = None, **how
) -> DataFrame:
    """``(run, seed, iter, rank, u, i, value, time)`` of every policy with every seed; time in milliseconds since the row before.

    ratings: ``(u, i, r[, known])`` over codes. stored: ``(run, seed, iter, rank, u, i)`` of interrupted runs, which go on where they
    stopped: what they recommended is learnt and given out again first.
    """
    n = ratings.count()
    if n > MOST_RATINGS:
        raise ValueError(f"{n} ratings; a closed loop holds {MOST_RATINGS} at most. Replay a log instead")
    pair = (F.col("u").cast("bigint") * n_items + F.col("i")).alias("pair")
    has, again = "known" in ratings.columns, stored is not None
    at = F.struct(F.lit(0).alias("k"), F.lit(0).alias("iter"), F.lit(0).alias("rank"), pair).alias("at")
    rows = ratings.select(at, pair, F.col("r").cast("double").alias("r"), *([F.coalesce("known", F.lit(False)).alias("known")] if has else []))
    if again:
        at = F.struct(F.lit(1).alias("k"), F.col("iter").cast("int").alias("iter"), F.col("rank").cast("int").alias("rank"), pair).alias("at")
        rows = rows.unionByName(stored.select(at, pair, F.col("run").cast("string").alias("run"), F.col("seed").cast("int").alias("seed")), allowMissingColumns=True)

    def work(spec: Spec, seed: int) -> Callable:
        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts, done = [], []
            for b in batches:
                if again:
                    mine = b[(b["run"] == spec.name) & (b["seed"] == seed)]
                    done += [divmod(int(p), n_items) for p in mine["pair"]]
                    b = b[b["run"].isna()]
                parts.append((b["pair"].to_numpy(np.int64), b["r"].to_numpy(float), b["known"].to_numpy(bool) if has else np.zeros(0, bool)))
            if parts:
                pairs, values, flags = (np.concatenate(x) for x in zip(*parts, strict=True))
                data = Ratings(pairs // n_items, pairs % n_items, values, n_users, n_items, flags if has else None, threshold)
                steps = run(spec.build(n_users, n_items, seed, ties), data, seed, limit, stored=done, **how)
                yield from _given_out(_timed(steps), ["iter", "rank", "u", "i", "value", "time"], spec, seed)

        return one

    return side_by_side(rows, specs, seeds, work, RUN_SCHEMA).withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def replay_log(log: DataFrame, specs: list[Spec], seeds: list[int], n_users: int, n_items: int, ties: str = "random", extra: int = 0, train: DataFrame | None = None) -> DataFrame:
    """``(run, seed, seq, u, i, reward)`` of the rows each policy matches. log: ``(seq, u, i, reward, cands)``.

    The log streams through each run's task in its order, so the task holds the policy's state and not the log. extra: that many random
    items besides the featured one as candidates, instead of the logged ones. train: rows ``(seq, u, i, reward)`` that every policy
    learns before the log begins.
    """
    columns = ["seq", "u", "i", "reward", "cands"]
    rows = log.where("u IS NOT NULL AND i IS NOT NULL").select(F.struct(F.lit(1).alias("k"), "seq").alias("at"), *(F.col(c) if c != "reward" else F.col(c).cast("double") for c in columns))
    if train is not None:
        warm = train.where("u IS NOT NULL AND i IS NOT NULL").select(
            F.struct(F.lit(0).alias("k"), "seq").alias("at"), "seq", "u", "i", F.col("reward").cast("double").alias("reward"), F.lit(None).cast("array<int>").alias("cands")
        )
        rows = rows.unionByName(warm)

    def work(spec: Spec, seed: int) -> Callable:
        def lines(batches: Iterator[pd.DataFrame], policy) -> Iterator[tuple]:
            for b in batches:
                for seq, u, i, reward, cands in zip(*(b[c].tolist() for c in columns), strict=True):
                    if cands is None:
                        policy.update(u, i, reward)
                    else:
                        yield seq, u, i, reward, np.asarray(cands)

        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            policy = spec.build(n_users, n_items, seed, ties)
            found = replay(policy, lines(batches, policy), extra, np.random.default_rng([seed, 1]))
            yield from _given_out(chain(found), ["seq", "u", "i", "reward"], spec, seed)

        return one

    out = side_by_side(rows, specs, seeds, work, "run string, seed int, seq bigint, u int, i int, reward double")
    return out.withColumn("reward", F.nanvl("reward", F.lit(None).cast("double")))
