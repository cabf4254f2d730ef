"""Metric curves over recommendation runs, at every interval-th row and the last.

Runs are cut to segments of interval rows. What a metric needs is added up for each segment first, and runs over
segments; so no window ever holds a run's rows, only its segments.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloop.operators.prefix import numbered, running


def with_iterations(runs: DataFrame, order: str = "seq") -> DataFrame:
    """runs with ``iter``, the place of each row in its run, from 1."""
    return numbered(runs, ["run"], order, "iter")


def _segments(runs: DataFrame, interval: int) -> DataFrame:
    return runs.withColumn("seg", F.ceil(F.col("iter") / interval).cast("bigint"))


def cumulative(runs: DataFrame, sums: dict[str, Column], interval: int) -> DataFrame:
    """``(run, point, ...)``: the sums up to each point; point is an iteration."""
    segs = _segments(runs, interval).groupBy("run", "seg").agg(F.max("iter").alias("point"), *(F.sum(c).alias(n) for n, c in sums.items()))
    upto = Window.partitionBy("run").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return segs.select("run", "point", *(F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(n) for n in sums))


@dataclass(frozen=True)
class Metric:
    """A metric of one's own: named sums over a run's rows, and its value at a point as an expression over the sums so far."""

    name: str
    sums: dict[str, Column]
    value: Column


def curve(runs: DataFrame, metrics: list[Metric], interval: int) -> DataFrame:
    """``(run, point, ...)``: the metrics' values at each point, from one pass over the runs."""
    named = {f"_{m.name}_{n}": c for m in metrics for n, c in m.sums.items()}
    rows = cumulative(runs, named, interval)
    for m in metrics:
        rows = rows.withColumnsRenamed({f"_{m.name}_{n}": n for n in m.sums}).withColumn(m.name, m.value).drop(*(n for n in m.sums if n != m.name))
    return rows


def points(runs: DataFrame, interval: int) -> DataFrame:
    return _segments(runs, interval).groupBy("run", "seg").agg(F.max("iter").alias("point"))


def frequencies(runs: DataFrame, interval: int) -> DataFrame:
    """``(run, point, freq, m)``: how many items had been recommended freq times up to each point, freq > 0.

    Items of one frequency are one row: there are few different frequencies, however many items.
    """
    seg = _segments(runs, interval)
    last = seg.groupBy("run").agg(F.max("seg").alias("_last"))
    per = seg.groupBy("run", "i", "seg").agg(F.count("*").alias("_n"))
    own = Window.partitionBy("run", "i").orderBy("seg")
    per = per.withColumn("freq", F.sum("_n").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_next", F.lead("seg").over(own))
    # An item enters a frequency in one segment and leaves it in another; what runs over segments is the sum of both.
    enter = per.select("run", "freq", "seg", F.lit(1).alias("_d"))
    leave = per.where("_next IS NOT NULL").select("run", "freq", F.col("_next").alias("seg"), F.lit(-1).alias("_d"))
    change = enter.unionByName(leave).groupBy("run", "freq", "seg").agg(F.sum("_d").alias("_d"))
    one = Window.partitionBy("run", "freq").orderBy("seg")
    held = change.withColumn("m", F.sum("_d").over(one.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_until", F.lead("seg").over(one))
    held = held.where("m > 0").join(F.broadcast(last), "run")  # a row for each run
    held = held.select("run", "freq", "m", F.explode(F.sequence("seg", F.coalesce(F.col("_until") - 1, F.col("_last")))).alias("seg"))
    return held.join(points(runs, interval), ["run", "seg"]).select("run", "point", "freq", "m")


def last_frequencies(runs: DataFrame, interval: int, k: int) -> DataFrame:
    """``(run, point, freq, m)`` over the last k rows up to each point."""
    at = points(runs, interval)
    seg = F.sequence(F.ceil(F.col("iter") / interval).cast("bigint"), F.ceil((F.col("iter") + (k - 1)) / interval).cast("bigint"))
    rows = runs.select("run", "i", "iter", F.explode(seg).alias("seg")).join(at, ["run", "seg"])
    rows = rows.where((F.col("iter") <= F.col("point")) & (F.col("iter") > F.col("point") - k))
    return rows.groupBy("run", "point", "i").agg(F.count("*").alias("freq")).groupBy("run", "point", "freq").agg(F.count("*").alias("m"))


def gini(freqs: DataFrame, n_items: Column, by: list[str]) -> DataFrame:
    """``(by..., gini)`` of frequencies (freq, m) over n_items items, those not listed having 0; null for one item or
    nothing recommended. Items of one frequency take neighbouring ranks, so their ranks' sum has a closed form."""
    rows = freqs.where("freq > 0").withColumn("_all", n_items)
    below = Window.partitionBy(*by).orderBy("freq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("m").over(below), F.lit(0)))
    got = F.sum("m")
    # Ranks of a frequency: zeros + before + 1 ... zeros + before + m, where zeros = all - got.
    weighted = F.sum(F.col("freq") * F.col("m") * (2 * F.col("_before") + F.col("m")).cast("double"))
    total = F.sum(F.col("freq") * F.col("m"))
    rank_sum = weighted + total * (2.0 * (F.max("_all") - got) - F.max("_all"))
    value = F.when((F.max("_all") > 1) & (total > 0), rank_sum / ((F.max("_all") - 1) * total))
    return rows.groupBy(*by).agg(value.alias("gini"))


def popularity_before(runs: DataFrame, order: str = "seq") -> DataFrame:
    """runs with ``before``: how often the row's item had been recommended in the run before this row."""
    rows = runs.withColumn("_one", F.lit(1))
    return running(rows, ["run", "i"], order, {"before": F.col("_one")}).withColumn("before", F.col("before") - 1).drop("_one")


def epc(freqs: DataFrame, n_users: Column) -> DataFrame:
    """``(run, point, epc)``: 1 - sum of squared frequencies / (users x recommendations)."""
    squares, total = F.sum(F.col("freq") * F.col("freq") * F.col("m")), F.sum(F.col("freq") * F.col("m"))
    return freqs.withColumn("_users", n_users).groupBy("run", "point").agg((1.0 - squares / (F.max("_users") * total)).alias("epc"))


def first_only(runs: DataFrame) -> DataFrame:
    """The rows by which a run recommends a pair for the first time."""
    first = runs.groupBy("run", "u", "i").agg(F.min("seq").alias("seq"))
    return runs.join(first, ["run", "u", "i", "seq"], "left_semi")


def intra_list_distance(runs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(run, ild)``: mean over users of the mean cosine distance between a user's items.

    vectors: ``(i, dim, x)`` of unit vectors. The sum over pairs follows from the length of the sum of the vectors, so
    pairs are never formed. Users with fewer than two items don't count.
    """
    items = runs.select("run", "u", "i").distinct()
    size = items.join(vectors.select("i").distinct(), "i").groupBy("run", "u").agg(F.count("*").alias("_n")).where("_n > 1")
    sums = items.join(vectors, "i").groupBy("run", "u", "dim").agg(F.sum("x").alias("_x"))
    length = sums.groupBy("run", "u").agg(F.sum(F.col("_x") * F.col("_x")).alias("_s")).join(size, ["run", "u"])
    mean = 1.0 - (F.col("_s") - F.col("_n")) / (F.col("_n") * (F.col("_n") - 1))
    return length.groupBy("run").agg(F.avg(mean).alias("ild"))


def intra_list_distances(runs: DataFrame, vectors: DataFrame, interval: int) -> DataFrame:
    """``(run, point, ild)``: the mean distance within users' lists up to each point; null while no user has two items.

    A user's mean only changes in segments in which the user gets a new item. So the change is computed there, and what
    runs over a run's segments is the sum of all users' changes.
    """
    seg = _segments(runs, interval).where("u IS NOT NULL")
    new = seg.join(vectors.select("i").distinct(), "i").groupBy("run", "u", "i").agg(F.min("seg").alias("seg"))
    own = Window.partitionBy("run", "u").orderBy("seg")
    size = new.groupBy("run", "u", "seg").agg(F.count("*").alias("_n"))
    size = size.withColumn("_n", F.sum("_n").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    per_dim = Window.partitionBy("run", "u", "dim").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = new.join(vectors, "i").groupBy("run", "u", "seg", "dim").agg(F.sum("x").alias("_x")).withColumn("_x", F.sum("_x").over(per_dim))
    length = sums.groupBy("run", "u", "seg").agg(F.sum(F.col("_x") * F.col("_x")).alias("_s")).join(size, ["run", "u", "seg"]).where("_n > 1")
    mean = length.withColumn("_d", 1.0 - (F.col("_s") - F.col("_n")) / (F.col("_n") * (F.col("_n") - 1)))
    change = mean.withColumn("_old", F.lag("_d").over(own))
    per = change.groupBy("run", "seg").agg(F.sum(F.col("_d") - F.coalesce("_old", F.lit(0.0))).alias("_d"), F.count_if(F.col("_old").isNull()).alias("_users"))
    upto = Window.partitionBy("run").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = points(runs, interval).join(per, ["run", "seg"], "left")
    return every.select("run", "point", (F.sum("_d").over(upto) / F.nullif(F.sum("_users").over(upto), F.lit(0))).alias("ild"))


def running_mean(per_ranking: DataFrame, value: str, interval: int) -> DataFrame:
    """``(run, point, mean)``: the mean, up to each point, of any metric of single rankings, one row for each iter."""
    sums = cumulative(per_ranking, {"_s": F.col(value), "_n": F.when(F.col(value).isNotNull(), 1)}, interval)
    return sums.select("run", "point", (F.col("_s") / F.nullif(F.col("_n"), F.lit(0))).alias("mean"))
