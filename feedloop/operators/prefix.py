"""Running sums and numbering without a single-partition window.

A window over one long order ends up in one task. Here the order is cut to blocks: sums run within a block, blocks'
totals run over blocks (few rows), and the two are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloop.session import cut

#: Steps of the order column in one block.
BLOCK = 1 << 16


def running(df: DataFrame, part: list[str], order: str, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """df with, for each name, the sum of its column over the part's rows up to this one.

    order must be a whole number, different for each row of a part; rows without it are dropped.
    """
    rows = df.where(F.col(order).isNotNull()).withColumns({n: F.coalesce(c.cast("double" if n.startswith("_d") else "bigint"), F.lit(0)) for n, c in sums.items()})
    rows = rows.withColumn("_block", F.floor(F.col(order) / block))
    inside = Window.partitionBy(*part, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy(*part, "_block").agg(*(F.sum(n).alias(n) for n in sums))
    base = _before_blocks(totals, part, list(sums))
    rows = rows.withColumns({n: F.sum(n).over(inside) for n in sums}).join(base, [*part, "_block"])
    return rows.withColumns({n: F.col(n) + F.col(f"_base_{n}") for n in sums}).drop("_block", *(f"_base_{n}" for n in sums))


#: Blocks in one group of blocks, whose totals are added up side by side.
GROUP = 1 << 12


def _before_blocks(totals: DataFrame, part: list[str], names: list[str]) -> DataFrame:
    """``(part, _block, _base_name...)``: the sums over earlier blocks, by groups of blocks, so that no task sees all blocks of a part."""
    grouped = totals.withColumn("_group", F.floor(F.col("_block") / GROUP))
    within = Window.partitionBy(*part, "_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*part).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy(*part, "_group").agg(*(F.sum(n).alias(n) for n in names))
    groups = groups.select(*part, "_group", *(F.coalesce(F.sum(n).over(across), F.lit(0)).alias(f"_group_{n}") for n in names))
    inner = grouped.select(*part, "_group", "_block", *(F.coalesce(F.sum(n).over(within), F.lit(0)).alias(f"_inner_{n}") for n in names))
    return inner.join(groups, [*part, "_group"]).select(*part, "_block", *((F.col(f"_inner_{n}") + F.col(f"_group_{n}")).alias(f"_base_{n}") for n in names))


def numbered(df: DataFrame, part: list[str], order: str, name: str) -> DataFrame:
    """df with the place of each row in its part's order, from 1."""
    return running(df, part, order, {name: F.lit(1)})


def sums_before(df: DataFrame, order: list[str], n: str, settled: bool = False) -> DataFrame:
    """df with ``_before``, the sum of n over all rows that come earlier in the order.

    The rows are range-partitioned by the order; only one total per partition goes through the driver. settled: df comes
    from a checkpoint and is cheap to read twice.
    """
    ranged = cut((df if settled else cut(df)).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = sorted((r[0], r[1]) for r in ranged.groupBy("_range").agg(F.sum(n)).collect())
    base, done = [], 0
    for part, total in totals:
        base.append((part, done))
        done += total
    offsets = F.broadcast(df.sparkSession.createDataFrame(base or [(0, 0)], "_range int, _base bigint"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(offsets, "_range").withColumn("_before", F.col("_base") + F.coalesce(F.sum(n).over(inside), F.lit(0)))


def dense_codes(df: DataFrame, key: str) -> DataFrame:
    """``(key, code)``: the distinct non-null keys, coded from 0 in their order."""
    keys = df.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_n", F.lit(1))
    return sums_before(keys, [key], "_n").select(key, F.col("_before").alias("code"))
