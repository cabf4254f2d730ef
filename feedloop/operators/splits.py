"""Partitions of an ordered log, and statistics of its training parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloop.operators.prefix import running


def uniform(log: DataFrame, order: str, parts: int) -> DataFrame:
    """log with ``place`` (from 1) and ``part``: part p holds the places after floor(n p / parts)."""
    n = F.broadcast(log.where(F.col(order).isNotNull()).agg(F.count("*").alias("_n")))
    rows = running(log, [], order, {"place": F.lit(1)}).crossJoin(n)
    return rows.withColumn("part", (F.ceil(F.col("place") * parts / F.col("_n")) - 1).cast("int")).drop("_n")


def by_relevant(log: DataFrame, order: str, relevant: Column, parts: int) -> DataFrame:
    """``(part, end)``: the place at which the running count of relevant rows reaches n_relevant x part / parts."""
    rows = running(log, [], order, {"place": F.lit(1), "_rel": relevant.cast("int")})
    total = F.broadcast(rows.agg(F.max("_rel").alias("_all")))
    # Each relevant row can only be the first to reach the quotas between its count less one and its count.
    hit = rows.where(relevant).crossJoin(total)
    low, high = F.floor((F.col("_rel") - 1) * parts / F.col("_all")) + 1, F.floor(F.col("_rel") * parts / F.col("_all"))
    hit = hit.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    wide = hit.select(F.explode(F.sequence("_low", "_high")).alias("part"), F.col("place").alias("end"))
    return wide.select(F.col("part").cast("int").alias("part"), "end")


def first_percent(log: DataFrame, order: str, share: float) -> DataFrame:
    """The first floor(share x n) rows."""
    n = F.broadcast(log.where(F.col(order).isNotNull()).agg(F.floor(F.lit(share) * F.count("*")).alias("_n")))
    return running(log, [], order, {"place": F.lit(1)}).crossJoin(n).where("place <= _n").drop("_n")


def training_statistics(rows: DataFrame, parts: int) -> DataFrame:
    """``(split, recs, ratings, relevant)`` of the first 1, 2, ... parts; rows: ``(part, r, relevant)``."""
    per = rows.groupBy("part").agg(F.count("*").alias("recs"), F.count("r").alias("ratings"), F.count_if("relevant").alias("relevant"))
    wide = per.select(F.explode(F.sequence(F.col("part") + 1, F.lit(parts))).alias("split"), "recs", "ratings", "relevant")
    return wide.groupBy("split").agg(*(F.sum(c).alias(c) for c in ("recs", "ratings", "relevant")))


def warmup(rows: DataFrame, full: bool) -> DataFrame:
    """The pairs that a policy is warmed up with: rated ones only, or also the unrated with a null value."""
    return rows if full else rows.where(F.col("r").isNotNull())
