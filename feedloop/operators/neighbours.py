"""Neighbourhoods: similarities of a stated set of queries with all users or items, and what they recommend."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloop.operators.hot import split_join
from feedloop.operators.tiles import similar


def co_ratings(queries: DataFrame, state: DataFrame) -> DataFrame:
    """``(a, b, dot, common)`` for each query a and each other b with a common item. Both: ``(k, i, r)``.

    The queries are a stated, small part; the state is only joined with them, by item, hot items in shares.
    """
    left = queries.select(F.col("k").alias("a"), "i", F.col("r").alias("_x"))
    right = state.select(F.col("k").alias("b"), "i", F.col("r").alias("_y"))
    pairs = split_join(left, right, "i").where("a <> b")
    return pairs.groupBy("a", "b").agg(F.sum(F.col("_x") * F.col("_y")).alias("dot"), F.count("*").alias("common"))


def norms(state: DataFrame) -> DataFrame:
    return state.groupBy("k").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))


def cosine(queries: DataFrame, state: DataFrame) -> DataFrame:
    """``(a, b, sim)``: cosine of the rating vectors."""
    own = norms(state)
    pairs = co_ratings(queries, state).join(own.select(F.col("k").alias("a"), F.col("norm").alias("_na")), "a")
    pairs = pairs.join(own.select(F.col("k").alias("b"), F.col("norm").alias("_nb")), "b")
    return pairs.select("a", "b", (F.col("dot") / (F.col("_na") * F.col("_nb"))).alias("sim"))


def restricted_cosine(queries: DataFrame, state: DataFrame) -> DataFrame:
    """``(a, b, sim)``: inner product over the number of common items; only what is positive."""
    return co_ratings(queries, state).select("a", "b", (F.col("dot") / F.col("common")).alias("sim")).where("sim > 0")


def beta_exact(queries: DataFrame, positives: DataFrame, alpha: float, beta: float) -> DataFrame:
    """``(a, b, sim)``: (common positives + alpha) / (positives of b + beta), for pairs with a common positive."""
    count = positives.groupBy(F.col("k").alias("b")).agg(F.count("*").alias("_n"))
    hits = co_ratings(queries, positives).join(count, "b")
    return hits.select("a", "b", ((F.col("common") + alpha) / (F.col("_n") + beta)).alias("sim"))


def nearest(sims: DataFrame, k: int) -> DataFrame:
    """The k most similar b of each a, ties by b; similarities compare rounded to 9 places, so that ties are ties."""
    order = Window.partitionBy("a").orderBy(F.round("sim", 9).desc(), "b")
    return sims.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= k)


def nearest_to(queries: DataFrame, state: DataFrame, kind: str, k: int, alpha: float = 1.0, beta: float = 2.0) -> DataFrame:
    """nearest() of cosine, restricted (cosine) or beta (exact), r positive and the queries with all of their rows. Similarities are
    worked out in tiles, of which only the k best of each part of the state go on, so that no pairs are shuffled."""
    kept = queries.schema["k"].dataType
    best = nearest(similar(queries, state, kind, k, alpha, beta), k)
    return best.withColumns({c: F.col(c).cast(kept) for c in ("a", "b")})


#: Up to so many items, inner products of all pairs are summed in blocks of a table; beyond, pairs are joined and grouped.
DENSE = 20_000
BLOCK_MB, BLOCKS = 32, 12


def nearest_of_all(state: DataFrame, k: int) -> DataFrame:
    """nearest(cosine(state, state), k), with every item as a query. state: ``(k, i, r)``, an item's users, r positive.

    A user's items travel as one row to each block of items that has some of them; a block's inner products with all
    items are summed there, so that no pairs are shuffled.
    """
    code = F.xxhash64(F.col("k").cast("bigint"))
    own = norms(state).withColumn("h", code).orderBy("k").limit(DENSE + 1).toPandas()
    n = len(own)
    if n > DENSE:
        return nearest(cosine(state, state), k)
    items, norm = own["k"].to_numpy(np.int64), own["norm"].to_numpy(float)
    blocks = max(BLOCKS, -(-n * n * 8 // (BLOCK_MB << 20)))
    block_of = own["h"].to_numpy(np.int64) % blocks
    members = [np.flatnonzero(block_of == x) for x in range(blocks)]
    place = np.zeros(n, np.int64)
    for own_items in members:
        place[own_items] = np.arange(len(own_items))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dots: dict[int, np.ndarray] = {}
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            codes = np.searchsorted(items, batch.column(1).values.to_numpy())
            values = batch.column(2).flatten().to_numpy()
            first = ends[0]
            codes = codes[first : ends[-1]]
            where, row = block_of[codes], place[codes]
            for block, a, z in zip(batch.column(0).to_pylist(), (ends[:-1] - first).tolist(), (ends[1:] - first).tolist(), strict=True):
                if block not in dots:
                    dots[block] = np.zeros((len(members[block]), n))
                c, v = codes[a:z], values[a:z]
                inside = np.flatnonzero(where[a:z] == block)
                dots[block][row[a:z][inside][:, None], c] += v[inside][:, None] * v
        for block, dot in dots.items():
            for at, a in enumerate(members[block]):
                others = np.flatnonzero(dot[at])
                others = others[others != a]
                sim = dot[at, others] / (norm[a] * norm[others])
                best = np.lexsort((items[others], -np.round(sim, 9)))[:k]
                cols = (np.full(len(best), items[a]), items[others[best]], sim[best], np.arange(1, len(best) + 1))
                yield pa.record_batch([pa.array(x) for x in cols], names=["a", "b", "sim", "place"])

    rows = state.groupBy("i").agg(F.collect_list(F.struct("k", F.col("r").cast("double").alias("r"))).alias("own"))
    rows = rows.select(F.col("own.k").alias("items"), F.col("own.r").alias("values"))
    to = F.array_distinct(F.transform("items", lambda x: F.pmod(F.xxhash64(x.cast("bigint")), F.lit(blocks)).cast("int")))
    rows = rows.select(F.explode(to).alias("block"), "items", "values").repartition(blocks, "block")
    return rows.mapInArrow(kernel, "a bigint, b bigint, sim double, place bigint")


def by_users(near: DataFrame, state: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """``(u, i, score, place)``: the k unseen items with the highest sum of similarity x neighbour's value."""
    votes = near.join(state.select(F.col("k").alias("b"), "i", "r"), "b")
    scores = votes.groupBy(F.col("a").alias("u"), "i").agg(F.sum(F.col("sim") * F.col("r")).alias("score"))
    return _best(scores.join(seen, ["u", "i"], "left_anti"), k)


def by_items(near: DataFrame, own: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """``(u, i, score, place)`` from similar items b of the items a that the users in own ``(u, i, r)`` rated."""
    votes = own.select("u", F.col("i").alias("a"), "r").join(near, "a")
    scores = votes.groupBy("u", F.col("b").alias("i")).agg(F.sum(F.col("sim") * F.col("r")).alias("score"))
    return _best(scores.join(seen, ["u", "i"], "left_anti"), k)


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("u").orderBy(F.round("score", 9).desc(), "i")
    return scores.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= k)
