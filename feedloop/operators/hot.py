"""Joins on keys of which a few hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloop.session import cut

#: Rows of a key that one task joins; a key with more is dealt to shares.
SHARE = 20_000
#: Keys with shares that are broadcast; with more, the join is left to the engine's skew handling.
SMALL = 1_000_000


def split_join(left: DataFrame, right: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """left joined with right by key, right being the larger side. Rows of a key with many rows on the right are dealt to
    shares, and the key's rows on the left go to each of them, so that no task gets all of a hot key. Null keys don't join."""
    counts = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > share)
    heavy = cut(counts.select(key, F.ceil(F.col("_n") / share).cast("int").alias("_shares")))
    n = heavy.count()
    if n == 0 or n > SMALL:
        return left.join(right, key)
    heavy = F.broadcast(heavy)
    one = F.coalesce("_shares", F.lit(1))
    dealt = F.pmod(F.xxhash64(*[F.col(c) for c in right.columns]), one).cast("int")
    right = right.join(heavy, key, "left").withColumn("_share", dealt).drop("_shares")
    left = left.join(heavy, key, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), one - 1))).drop("_shares")
    return left.join(right, [key, "_share"]).drop("_share")
