"""Interaction logs: candidates, replay of a frozen policy, and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloop.operators.prefix import numbered


def with_candidates(log: DataFrame) -> DataFrame:
    """``(seq, u, i, reward, cands)`` of rows with a featured item: candidates are a set that holds the featured item."""
    cands = F.coalesce(F.col("cands"), F.array().cast("array<int>"))
    return log.where("iidx IS NOT NULL").select(
        "seq", F.col("uidx").alias("u"), F.col("iidx").alias("i"), "reward", F.array_compact(F.array_union(cands, F.array("iidx"))).alias("cands")
    )


def replay_matches(log: DataFrame, scores: DataFrame) -> DataFrame:
    """The rows whose featured item is what a policy with these frozen scores ``(i, score)`` picks among the
    candidates (highest score, ties by item); a candidate without a score has the lowest."""
    wide = log.select("seq", F.explode("cands").alias("_c"))
    scored = wide.join(scores.select(F.col("i").alias("_c"), "score"), "_c", "left")
    pick = scored.groupBy("seq").agg(F.max_by("_c", F.struct(F.coalesce("score", F.lit(float("-inf"))), -F.col("_c"))).alias("_pick"))
    return log.join(pick, "seq").where(F.col("_pick") == F.col("i")).drop("_pick")


def pair_rates(log: DataFrame) -> DataFrame:
    """``(u, i, shown, clicked, rate)``: rows, positive rewards and their ratio for each pair."""
    per = log.groupBy("u", "i").agg(F.count("*").alias("shown"), F.count_if(F.col("reward") > 0).alias("clicked"))
    return per.withColumn("rate", F.col("clicked") / F.col("shown"))


def replay_statistics(log: DataFrame, key: str) -> DataFrame:
    """``(key, rows, relevant, repeated, repeated_relevant)``: repeated counts pairs that occur more than once."""
    per = pair_rates(log).where(F.col(key).isNotNull())
    again = F.col("shown") > 1
    return per.groupBy(key).agg(
        F.sum("shown").alias("rows"), F.sum("clicked").alias("relevant"), F.count_if(again).alias("repeated"),
        F.count_if(again & (F.col("clicked") > 0)).alias("repeated_relevant"),
    )


def active_users(log: DataFrame, least: int) -> DataFrame:
    return log.where("u IS NOT NULL").groupBy("u").agg(F.count("*").alias("rows")).where(F.col("rows") >= least)


def matched_prefix(log: DataFrame, train: DataFrame) -> DataFrame:
    """``(place, u, i, reward)``: training pairs ``(seq, u, i)`` laid beside the log, row by row; what agrees is kept."""
    pairs = numbered(train.select("seq", "u", "i").withColumn("_p", F.lit(0)), ["_p"], "seq", "place").select("place", "u", "i")
    rows = numbered(log.select("seq", "u", "i", "reward").withColumn("_p", F.lit(0)), ["_p"], "seq", "place").select("place", "u", "i", "reward")
    return rows.join(pairs, ["place", "u", "i"])


def after(log: DataFrame, n: int) -> DataFrame:
    """The log without its first n rows."""
    return numbered(log.withColumn("_p", F.lit(0)), ["_p"], "seq", "_place").where(F.col("_place") > n).drop("_p", "_place")
