"""Ratings: merge policies, views, relevance, restriction, availability and reveal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["u", "i"]


def interactions(ratings: DataFrame, low: float = 0.5, high: float = 5.0) -> DataFrame:
    """``(seq, u, i, r, known)`` of the rows with codes and a value of the scale; an unknown flag counts as not known."""
    good = F.col("uidx").isNotNull() & F.col("iidx").isNotNull() & F.col("value").between(low, high)
    return ratings.where(good).select(
        "seq", F.col("uidx").alias("u"), F.col("iidx").alias("i"), F.col("value").alias("r"), F.coalesce("known", F.lit(False)).alias("known")
    )


def merge(rows: DataFrame, policy: str) -> DataFrame:
    """One value for each (u, i): the first ("basic"), last, best, or the sum ("additive") of its rows."""
    by = {"basic": F.min_by("r", "seq"), "last": F.max_by("r", "seq"), "best": F.max("r"), "additive": F.sum("r")}
    return rows.groupBy(*PAIR).agg(by[policy].alias("r"))


def delete(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """The state without these pairs."""
    return state.join(pairs, PAIR, "left_anti")


def binarise(r: Column, threshold: float, use_ratings: bool) -> Column:
    """The value a policy sees: the rating, or 1 from the threshold on and else 0."""
    return r if use_ratings else F.when(r >= threshold, 1.0).otherwise(0.0)


def is_relevant(r: Column, threshold: float, use_ratings: bool = True) -> Column:
    """Whether a seen value is relevant; a missing one never is."""
    return F.coalesce(r >= threshold if use_ratings else r > 0, F.lit(False))


def view(rows: DataFrame, use: str) -> DataFrame:
    """Known, unknown or all rows."""
    if use not in ("known", "unknown", "all"):
        raise ValueError(f"no such view: {use}")
    return rows if use == "all" else rows.where("known" if use == "known" else "NOT known")


def restrict(state: DataFrame, pairs: DataFrame, both_ways: bool = False) -> DataFrame:
    """The state at the given pairs; both_ways: also at the reversed pairs, as undirected contacts need."""
    wanted = pairs.select(*PAIR)
    if both_ways:
        wanted = wanted.unionByName(pairs.select(F.col("i").alias("u"), F.col("u").alias("i"))).distinct()
    return state.join(wanted, PAIR, "left_semi")


def reveal(recommended: DataFrame, state: DataFrame) -> DataFrame:
    """The recommended pairs with their value ``r``; null where there is no rating."""
    return recommended.join(state.select(*PAIR, "r"), PAIR, "left")


def availability(seen: DataFrame, users: DataFrame, n_items: int) -> DataFrame:
    """``(u, available)``: how many items each user hasn't seen. The users x items table is never built."""
    count = seen.groupBy("u").agg(F.countDistinct("i").alias("_n"))
    return users.join(count, "u", "left").select("u", (F.lit(n_items) - F.coalesce("_n", F.lit(0))).cast("bigint").alias("available"))


def unseen_best(seen: DataFrame, users: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """``(u, i, place)``: the k best-ranked items that each user hasn't seen. ranked: ``(i, rank)`` from 1, no gaps.

    A user who saw n items has them within the first k + n ranks, so only those are looked at.
    """
    pairs = seen.select(*PAIR).distinct()
    count = users.join(pairs, "u", "left").groupBy("u").agg(F.count("i").alias("_n"))
    wide = count.select("u", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n") + k)).alias("rank")).join(ranked, "rank")
    left = wide.join(pairs, PAIR, "left_anti")
    return left.withColumn("place", F.row_number().over(Window.partitionBy("u").orderBy("rank")).cast("bigint")).where(F.col("place") <= k).select("u", "i", "place")
