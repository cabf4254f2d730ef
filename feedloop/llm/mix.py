"""Mixing sources to target weights: token budgets, subset-sum fitting by document length, seeded choice.

Documents are counted by source and exact token length. A source's budget is met by whole passes over the source, and
by one more copy of some documents whose lengths sum up to the rest: most of them are spread over the lengths in
proportion, and a bounded-knapsack table over the lengths left fits the remaining tokens exactly, or as nearly from
below as the lengths allow. Which documents of a length are taken follows from a seeded hash of their ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloop.llm.bpe import BYTE_BPE_50K, count
from feedloop.session import cut

#: A group of documents of one source and length with more than this many (or 1/GROUPS of all) is ranked in bins.
GROUP, GROUPS = 50_000, 10_000
#: Tokens that the knapsack table fits, in longest documents of the source; a bound on its size, not on the budget.
WINDOW = 8


def knapsack(lengths: np.ndarray, counts: np.ndarray, target: int) -> np.ndarray:
    """How many of each length to take, at most its count, so that the sum is the greatest that isn't above target."""
    taken = np.zeros(len(lengths), np.int64)
    reached = np.zeros(target + 1, bool)
    reached[0] = True
    by = np.full(target + 1, -1, np.int64)
    bundles: list[tuple[int, int]] = []
    for k, (size, left) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        left = min(left, target // size) if size else 0
        part = 1
        while left > 0 and not reached[target]:
            n = min(part, left)
            step = n * size
            new = np.flatnonzero(reached[: target + 1 - step]) + step
            new = new[~reached[new]]
            reached[new] = True
            by[new] = len(bundles)
            bundles.append((k, n))
            left -= n
            part *= 2
    at = int(np.flatnonzero(reached)[-1])
    # A sum is first reached by a bundle on top of one reached before it, so no bundle is used twice.
    while at:
        k, n = bundles[by[at]]
        taken[k] += n
        at -= n * int(lengths[k])
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """Documents of each length to take once so that their tokens sum up to the budget, or just below."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    # Integer arithmetic: budget / total of each count, rounded down.
    taken = np.array([n * budget // total for n in counts.tolist()], np.int64)
    left = budget - int((taken * lengths).sum())
    window = WINDOW * int(lengths.max(initial=1))
    order = np.random.default_rng(seed).permutation(len(lengths))
    order = order[taken[order] < counts[order]]
    if left > window and len(order):
        upto = np.cumsum(lengths[order])
        n = int(np.searchsorted(upto, left - window, "right"))
        taken[order[:n]] += 1
        left -= int(upto[n - 1]) if n else 0
    spare = counts - taken
    some = np.flatnonzero((spare > 0) & (lengths > 0) & (lengths <= left))
    some = some[np.random.default_rng(seed + 1).permutation(len(some))]
    taken[some] += knapsack(lengths[some], spare[some], left)
    return taken


def budgets(sources: list[dict], total: int | None) -> dict[str, int]:
    """Tokens for each source: its share of the total, no more than max_repeats passes; what capped or empty sources
    leave goes to the others in proportion to their shares. Without a total, it is the tokens that all sources have."""
    total = sum(s["tokens"] for s in sources) if total is None else total
    cap = {s["source"]: s["tokens"] * max(0, s["max_repeats"]) for s in sources}
    share = {s["source"]: max(0.0, s["target_share"]) for s in sources}
    out = {name: 0 for name in cap}
    open_, left = {n for n in cap if cap[n] and share[n]}, total
    while open_:
        weight = sum(share[n] for n in open_)
        full = {n for n in open_ if left * share[n] / weight >= cap[n]}
        if not full:
            for n in open_:
                out[n] = int(left * share[n] / weight)
            # Tokens lost by rounding go to the largest remainders, so that the whole total is given out.
            rest = sorted(open_, key=lambda n: (out[n] - left * share[n] / weight, n))
            for n in rest[: max(0, left - sum(out[n] for n in open_))]:
                out[n] += out[n] < cap[n]
            break
        for n in full:
            out[n] = cap[n]
            left -= cap[n]
        open_ -= full
    return out


def mixture(
    docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    total: int | None = None, seed: int = 7, path: str = BYTE_BPE_50K,
) -> tuple[DataFrame, DataFrame]:
    """The mix ``(key, source, n_tokens, copies)`` and its shares ``(source, target_share, max_repeats, n_docs,
    source_tokens, budget, mixed_docs, mixed_tokens, actual_share)``.

    targets has ``source, target_share, max_repeats``, one row for each source. Documents of a null or unlisted source,
    and null, empty or otherwise token-less texts are not in the mix; a listed source without documents has a share
    of 0. No document appears more than max_repeats times. Null shares and repeats count as 0. Same seed, same mix.
    """
    wanted = targets.where(F.col("source").isNotNull()).select(
        F.col("source").alias("_source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")
    )
    listed = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    listed = listed.join(wanted.select("_source"), "_source", "left_semi")
    sizes = cut(count(listed, ["_key", "_source"], "_text", path).where("n_tokens > 0"))

    groups = sizes.groupBy("_source", "n_tokens").agg(F.count("*").alias("n"))
    totals = groups.groupBy("_source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.sum("n").alias("n_docs"))
    rows = [r.asDict() | {"source": r["_source"]} for r in wanted.join(totals, "_source", "left").na.fill(0, ["tokens", "n_docs"]).collect()]
    budget = budgets(rows, total)
    tokens = {r["source"]: r["tokens"] for r in rows}
    n_docs = sum(r["n_docs"] for r in rows)

    # Groups too large for one task's sort are cut to bins by the hash that orders them.
    most = max(GROUP, n_docs // GROUPS)
    large = F.broadcast(groups.where(F.col("n") > most).select("_source", "n_tokens", F.ceil(F.col("n") / most).alias("_bins")))
    order = F.xxhash64(F.col("_key"), F.lit(seed))
    spread = F.shiftrightunsigned(order, 32) * F.coalesce("_bins", F.lit(1)) / F.lit(float(1 << 32))
    placed = sizes.join(large, ["_source", "n_tokens"], "left").withColumn("_order", order).withColumn("_bin", F.floor(spread)).drop("_bins")

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        name = group["_source"].iloc[0]
        group = group.sort_values("n_tokens")
        lengths, counts = group["n_tokens"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        passes = budget[name] // tokens[name]
        extra = fit(lengths, counts, budget[name] - passes * tokens[name], seed)
        return pd.DataFrame({"_source": name, "n_tokens": lengths, "_passes": passes, "_extra": extra})

    # One source's lengths at a time: as many rows as there are different lengths, however many documents.
    chosen = groups.groupBy("_source").applyInPandas(fitted, "_source string, n_tokens bigint, _passes bigint, _extra bigint")
    earlier = Window.partitionBy("_source", "n_tokens").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = placed.groupBy("_source", "n_tokens", "_bin").agg(F.count("*").alias("_n"))
    bins = bins.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    bins = bins.join(chosen, ["_source", "n_tokens"]).withColumn("_left", F.col("_extra") - F.col("_before"))
    rank = F.row_number().over(Window.partitionBy("_source", "n_tokens", "_bin").orderBy("_order", "_key"))
    ranked = placed.join(bins.select("_source", "n_tokens", "_bin", "_passes", "_left"), ["_source", "n_tokens", "_bin"])
    copies = F.col("_passes") + (rank <= F.col("_left")).cast("bigint")
    mix = ranked.withColumn("copies", copies).where("copies > 0")
    mix = mix.select(F.col("_key").alias(key), F.col("_source").alias(source), "n_tokens", F.col("copies").cast("int").alias("copies"))

    spark = docs.sparkSession
    goal = spark.createDataFrame([(r["source"], r["target_share"], r["max_repeats"], r["n_docs"], r["tokens"], budget[r["source"]]) for r in rows],
        "source string, target_share double, max_repeats int, n_docs bigint, source_tokens bigint, budget bigint")
    got = mix.groupBy(F.col(source).alias("source")).agg(F.sum("copies").alias("mixed_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    every = Window.partitionBy()  # a row for each listed source
    shares = goal.join(got, "source", "left").na.fill(0, ["mixed_docs", "mixed_tokens"])
    shares = shares.withColumn("actual_share", F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(every), F.lit(0)))
    return mix, shares
