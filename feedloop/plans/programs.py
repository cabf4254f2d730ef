"""The programs: recommend, validate, with and without warm-up, statistics, summaries, graphs and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloop.operators import curves as C
from feedloop.operators import graph as G
from feedloop.operators import preferences as P
from feedloop.operators import splits as D
from feedloop.policies.jobs import simulate
from feedloop.policies.registry import Spec


def _named(runs: DataFrame) -> DataFrame:
    """Runs as the curves take them; seq numbers a ranking's places one after another."""
    most = runs.agg(F.max("rank")).first()[0] or 1
    return runs.select(
        F.concat_ws("#", "run", "seed").alias("run"), F.col("run").alias("algorithm"), ((F.col("iter") - 1).cast("bigint") * most + F.col("rank")).alias("iter"),
        ((F.col("iter") - 1).cast("bigint") * most + F.col("rank")).alias("seq"), "u", "i", F.col("value").alias("r"),
        *(["time"] if "time" in runs.columns else []),
    )


#: Metrics of simulated runs; time is that spent since the point before, in milliseconds.
METRICS = ("recall", "evenness", "epc", "time")


def curves(runs: DataFrame, ratings: DataFrame, n_items: int, threshold: float, interval: int, n_users: int | None = None) -> DataFrame:
    """``(run, point, recall, evenness[, epc, time])`` of simulated runs; epc where n_users is given, time where runs have it."""
    named = _named(runs)
    total = max(1, ratings.where(F.col("r") >= threshold).count())
    hits = C.cumulative(named, {"hits": (F.col("r") >= threshold).cast("int")}, interval).withColumn("recall", F.col("hits") / total).drop("hits")
    freqs = C.frequencies(named, interval)
    even = C.gini(freqs, F.lit(n_items), ["run", "point"]).select("run", "point", (1 - F.col("gini")).alias("evenness"))
    out = hits.join(even, ["run", "point"])
    if n_users is not None:
        out = out.join(C.epc(freqs, F.lit(n_users)), ["run", "point"])
    if "time" in runs.columns:
        segment = F.ceil(F.col("iter") / interval)
        spent = named.groupBy("run", segment.alias("_seg")).agg(F.max("iter").alias("point"), F.sum("time").alias("time"))
        out = out.join(spent.select("run", "point", "time"), ["run", "point"])
    return out


def summary(curve: DataFrame, metrics: list[str]) -> DataFrame:
    """``(algorithm, point, metric...)``: means over a policy's seeds; a point counts the seeds that reached it."""
    named = curve.withColumn("algorithm", F.split("run", "#")[0])
    return named.groupBy("algorithm", "point").agg(*(F.avg(m).alias(m) for m in metrics))


def ranking(curve: DataFrame, metric: str) -> DataFrame:
    """``(algorithm, value)`` by the metric at the end of the runs, best first."""
    last = curve.groupBy("run").agg(F.max_by(metric, "point").alias("value")).withColumn("algorithm", F.split("run", "#")[0])
    return last.groupBy("algorithm").agg(F.avg("value").alias("value")).orderBy(F.desc("value"), "algorithm")


def at_points(curve: DataFrame, metric: str, points: list[int]) -> DataFrame:
    """Policies x points as text, "-" where a run didn't get there."""
    wide = summary(curve, [metric]).groupBy("algorithm").pivot("point", points).agg(F.first(metric).cast("string"))
    return wide.select("algorithm", *(F.coalesce(F.col(str(p)), F.lit("-")).alias(str(p)) for p in points))


def summaries(curve: DataFrame, metrics: list[str], points: list[int]) -> DataFrame:
    """``(metric, algorithm, point...)``: every metric's values at the points."""
    tables = [at_points(curve, m, points).select(F.lit(m).alias("metric"), "*") for m in metrics]
    return reduce(DataFrame.unionByName, tables)


def recommend(ratings: DataFrame, specs: list[Spec], seeds: list[int], limit: float, n_users: int, n_items: int, threshold: float, interval: int = 1000, **how) -> tuple[DataFrame, DataFrame]:
    """(runs, curves) of policies on a dataset."""
    runs = simulate(ratings, specs, seeds, limit, n_users, n_items, threshold, **how).persist()
    return runs, curves(runs, ratings, n_items, threshold, interval, n_users)


def validate(ratings: DataFrame, specs: list[Spec], seeds: list[int], limit: float, n_users: int, n_items: int, threshold: float, **how) -> DataFrame:
    """Policies ranked by the recall they end with."""
    runs, curve = recommend(ratings, specs, seeds, limit, n_users, n_items, threshold, **how)
    return ranking(curve, "recall")


def _training(train: DataFrame, ratings: DataFrame, full: bool):
    rows = D.warmup(P.reveal(train.select("seq", "u", "i"), ratings), full).orderBy("seq").toPandas()
    return tuple(rows[c].to_numpy(t) for c, t in (("u", int), ("i", int), ("r", float)))


def warm_recommend(train: DataFrame, ratings: DataFrame, specs: list[Spec] | list[list[Spec]], seeds: list[int], limit: float, n_users: int, n_items: int, threshold: float, parts: int, full: bool = False, relevant: bool = False, **how) -> DataFrame:
    """Runs of each split j, warmed up with the training log's first j parts; parts of equal rows, or equal relevant
    rows. specs: policies of all splits, or a list for each split. A column ``split`` is added."""
    rows = P.reveal(D.uniform(train.select("seq", "u", "i"), "seq", parts), ratings)
    if relevant:
        ends = D.by_relevant(P.reveal(train.select("seq", "u", "i"), ratings), "seq", P.is_relevant(F.col("r"), threshold), parts)
        cuts = sorted((r["part"], r["end"]) for r in ends.collect())
    else:
        cuts = sorted((r["part"] + 1, r["end"]) for r in rows.groupBy("part").agg(F.max("place").alias("end")).collect())
    out = None
    for j, end in cuts:
        own = specs[min(j, len(specs)) - 1] if specs and isinstance(specs[0], list) else specs
        warm = _training(rows.where(F.col("place") <= end), ratings, full)
        runs = simulate(ratings, own, seeds, limit, n_users, n_items, threshold, warm=warm, **how).withColumn("split", F.lit(j))
        out = runs if out is None else out.unionByName(runs)
    return out


def warm_validate(train: DataFrame, ratings: DataFrame, specs: list[Spec], seeds: list[int], limit: float, n_users: int, n_items: int, threshold: float, parts: int, ratio: float = 0.0, **how) -> DataFrame:
    """``(split, algorithm, value)``: policies ranked by recall on held-out pairs of the training log. With a ratio
    ("variable"), each split's first part of that size warms up and its rest is the test; else ("fixed") the last part
    of the log is the test for every split."""
    rows = D.uniform(train.select("seq", "u", "i"), "seq", parts).persist()
    n = rows.count()
    out = None
    ends = [n * j // parts for j in range(1, parts + (ratio > 0))]
    for j, end in enumerate(ends, 1):
        at = int(end * ratio) if ratio else end
        test = rows.where((F.col("place") > at) & (F.col("place") <= end)) if ratio else rows.where(F.col("place") > ends[-1])
        shown = P.restrict(ratings, test.select("u", "i").distinct().unionByName(rows.where(F.col("place") <= at).select("u", "i")).distinct())
        warm = _training(rows.where(F.col("place") <= at), ratings, False)
        runs = simulate(shown, specs, seeds, limit, n_users, n_items, threshold, warm=warm, **how)
        ranked = ranking(curves(runs, shown, n_items, threshold, 1000), "recall").withColumn("split", F.lit(j))
        out = ranked if out is None else out.unionByName(ranked)
    return out


def dataset_graph(ratings: DataFrame, threshold: float, queries: Column | None = None) -> DataFrame:
    """``(source, dest, weight)`` of users with more than one common relevant item, of all users or stated ones."""
    liked = ratings.where(F.col("r") >= threshold).select("u", "i")
    edges = G.co_rating_graph(liked, liked if queries is None else liked.where(queries))
    return edges.select(F.col("a").alias("source"), F.col("b").alias("dest"), "weight")


def dataset_analysis(ratings: DataFrame, threshold: float, limit: int) -> DataFrame:
    """``(least, edges, density, components, mean_distance, gini)`` of the users' graph as edges ask for more than 0, 1,
    ... limit - 1 common relevant items. gini is that of the components' sizes."""
    liked = ratings.where(F.col("r") >= threshold).select("u", "i")
    users = ratings.select(F.col("u").alias("v")).distinct()
    n = users.count()
    edges = G.co_rating_graph(liked, liked, least=1).where("a < b").persist()
    out = []
    for i in range(limit):
        part = edges.where(F.col("common") > i)
        labels = G.components(part.select(F.col("a").alias("src"), F.col("b").alias("dst")), users)
        sizes = labels.groupBy("component").agg(F.count("*").alias("freq")).groupBy("freq").agg(F.count("*").alias("m"))
        count = sizes.agg(F.sum("m")).first()[0] or 0
        uneven = C.gini(sizes.withColumn("all", F.lit("all")), F.lit(count), ["all"]).first()
        m, mean = part.agg(F.count("*"), F.avg("distance")).first()
        out.append((i, m, m / (n * (n - 1) / 2) if n > 1 else None, count, mean, uneven["gini"] if uneven else None))
    return ratings.sparkSession.createDataFrame(out, "least int, edges bigint, density double, components bigint, mean_distance double, gini double")


def rank_files(rows: DataFrame, point: int) -> DataFrame:
    """``(file, value, place)`` of summaries ``(file, iter, value)`` at an iteration, best first."""
    here = rows.where(F.col("iter") == point)
    return here.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), "file")))  # a row for each file
