"""Command line: python -m feedloop COMMAND ... ; see --help of each command."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloop.operators import curves as C
from feedloop.operators import logs as L
from feedloop.operators import preferences as P
from feedloop.operators import splits as D
from feedloop.operators.prefix import dense_codes
from feedloop.plans import programs
from feedloop.policies import registry
from feedloop.policies.jobs import replay_log
from feedloop.sources import text

COMMANDS = ("rec", "valid", "warmup-rec", "warmup-valid", "train-stats", "summarize", "warmup-summarize", "dataset", "dataset-analysis", "outputranker")


def _coded(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, int, int]:
    """``(u, i, r[, known])`` over codes, and how many users and items there are."""
    if args.type == "contact":
        edges = text.contacts(spark, args.data, args.directed)
        raw = edges.select(F.col("src").alias("user"), F.col("dst").alias("item"), F.lit(1.0).alias("rating"))
        ids = dense_codes(raw.select("user").unionByName(raw.select(F.col("item").alias("user"))), "user")
        users, items = ids, ids.withColumnRenamed("user", "item")
    else:
        raw = text.knowledge(spark, args.data, args.sep) if args.type == "knowledge" else text.ratings(spark, args.data, args.sep, item=args.item_ids)
        users, items = dense_codes(raw, "user"), dense_codes(raw, "item")
    rows = raw.join(users.withColumnRenamed("code", "u"), "user").join(items.withColumnRenamed("code", "i"), "item")
    value = P.binarise(F.col("rating"), args.threshold, args.use_ratings)
    known = [F.col("known")] if "known" in raw.columns else []
    return rows.select(F.col("u").cast("int").alias("u"), F.col("i").cast("int").alias("i"), value.alias("r"), *known).persist(), users.count(), items.count()


def _trained(spark: SparkSession, path: str) -> DataFrame:
    """A training run with ``seq``, which follows its iterations and the places within them."""
    rows = text.read_run(spark, path)
    most = rows.agg(F.max("rank")).first()[0] or 1
    return rows.withColumn("seq", F.col("iter").cast("bigint") * (most + 1) + F.col("rank"))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="feedloop")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--type", choices=("general", "contact", "knowledge", "stream"), default="general")
    p.add_argument("--data", help="ratings, edges or log")
    p.add_argument("--out", help="folder to write to")
    p.add_argument("--algorithms", help="JSON file of policies and their parameters")
    p.add_argument("--sep", default="::")
    p.add_argument("--item-ids", choices=("long", "string"), default="long")
    p.add_argument("--users", help="index file of users (stream)")
    p.add_argument("--items", help="index file of items (stream)")
    p.add_argument("--threshold", type=float, default=0.5)
    p.add_argument("--use-ratings", action="store_true")
    p.add_argument("--directed", action="store_true")
    p.add_argument("--not-reciprocal", action="store_true")
    p.add_argument("--use", choices=("known", "unknown", "all"), default="all")
    p.add_argument("--end", type=float, default=0.0, help="0: no limit; from 1 on: iterations; below: share of relevant ratings")
    p.add_argument("--seeds", type=int, nargs="*", default=[0])
    p.add_argument("--seed-file")
    p.add_argument("--interval", type=int, default=1000)
    p.add_argument("--cutoff", type=int, default=1)
    p.add_argument("--warmup", help="run file of training pairs")
    p.add_argument("--parts", type=int, default=5, help="below 0: parts of equal relevant ratings")
    p.add_argument("--ratio", type=float, default=0.0, help="share of each split that warms up; 0: fixed test")
    p.add_argument("--full", action="store_true", help="warm up with unrated pairs too")
    p.add_argument("--runs", nargs="*", default=[], help="run files or summaries")
    p.add_argument("--points", type=int, nargs="*", default=[1000])
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--selection", choices=("all", "limited"), default="all", help="what may be recommended: every item, or a random pool")
    p.add_argument("--pool", type=int, default=20, help="size of a limited pool; of a stream: random items besides the featured one, 0: those logged")
    p.add_argument("--user-choice", choices=("random", "round-robin", "random-round-robin"), default="random")
    p.add_argument("--resume", help="folder of run files that go on where they stopped")
    p.add_argument("--metrics", nargs="*", default=list(programs.METRICS), help="what a summary lists")
    return p


def main(argv: list[str], spark: SparkSession | None = None) -> DataFrame | None:
    args = _parser().parse_args(argv)
    if args.type == "stream" and args.cutoff > 1:
        raise SystemExit("rankings can't be replayed")
    spark = spark or SparkSession.builder.appName("feedloop").getOrCreate()
    seeds = text.seeds(spark, args.seed_file) if args.seed_file else args.seeds
    lists = registry.load(args.algorithms) if args.algorithms else []
    specs = list({s.name: s for part in lists for s in part}.values())
    how = {"selection": args.selection, "pool": args.pool, "users": args.user_choice, "cutoff": args.cutoff, "use": args.use, "learn": ("reciprocal" if args.not_reciprocal else "general") if args.directed or args.type != "contact" else "undirected"}
    if args.command == "outputranker":
        files = None
        for f in args.runs:
            rows = spark.read.option("sep", "\t").option("header", True).csv(f)
            rows = rows.select(F.lit(f).alias("file"), F.col(rows.columns[0]).cast("int").alias("iter"), F.col(rows.columns[-1]).cast("double").alias("value"))
            files = rows if files is None else files.unionByName(rows)
        out = programs.rank_files(files, args.points[0])
    elif args.type == "stream":
        log = text.log(spark, args.data)
        n_users, n_items = text.index(spark, args.users).count(), text.index(spark, args.items).count()
        first = None
        if args.warmup:  # what a training run and the log agree on is learnt before the rest of the log
            train = _trained(spark, args.warmup)
            first, log = L.matched_prefix(log, train).withColumnRenamed("place", "seq"), L.after(log, train.count())
        extra = args.pool if args.selection == "limited" else 0
        runs = replay_log(log, specs, seeds, n_users, n_items, extra=extra, train=first).withColumn("run", F.concat_ws("#", "run", "seed"))
        curve = C.cumulative(C.with_iterations(runs), {"clicks": (F.col("reward") >= args.threshold).cast("int"), "counter": F.lit(1)}, args.interval)
        curve = curve.withColumn("ctr", F.col("clicks") / F.col("counter"))
        out = programs.ranking(curve, "ctr") if args.command == "valid" else programs.summary(curve, ["ctr", "counter"])
    else:
        ratings, n_users, n_items = _coded(spark, args)
        if not args.use_ratings:  # values are 0 or 1 from here on
            args.threshold = 0.5
        base = (ratings, specs, seeds, args.end, n_users, n_items, args.threshold)
        train = _trained(spark, args.warmup) if args.warmup else None
        if args.resume:
            how["stored"] = text.read_runs(spark, args.resume)
        if args.command == "rec":
            runs, curve = programs.recommend(*base, interval=args.interval, **how)
            out = programs.summary(curve, [m for m in args.metrics if m in curve.columns])
            if args.out:
                text.write_runs(runs, f"{args.out}/runs")
        elif args.command == "valid":
            out = programs.validate(*base, **how)
        elif args.command == "warmup-rec":
            if len(lists) > 1:  # a list of policies for each split
                base = (ratings, lists, *base[2:])
            out = programs.warm_recommend(train, *base, parts=abs(args.parts), full=args.full, relevant=args.parts < 0, **how)
        elif args.command == "warmup-valid":
            out = programs.warm_validate(train, *base, parts=abs(args.parts), ratio=args.ratio, **how)
        elif args.command == "train-stats":
            rows = P.reveal(D.uniform(train, "seq", abs(args.parts)), ratings).withColumn("relevant", P.is_relevant(F.col("r"), args.threshold))
            out = D.training_statistics(rows, abs(args.parts))
        elif args.command in ("summarize", "warmup-summarize"):
            runs = None
            for f in args.runs:
                rows = text.read_run(spark, f).select(F.lit(f).alias("run"), F.lit(0).alias("seed"), "iter", "rank", "u", "i", "time")
                runs = rows if runs is None else runs.unionByName(rows)
            seen = P.reveal(runs, ratings).withColumnRenamed("r", "value")
            if train is not None:  # what was trained on doesn't count
                seen, ratings = P.delete(seen, train), P.delete(ratings, train)
            curve = programs.curves(seen, ratings, n_items, args.threshold, args.interval, n_users)
            out = programs.summaries(curve, [m for m in args.metrics if m in curve.columns], args.points)
        elif args.command == "dataset":
            out = programs.dataset_graph(ratings, args.threshold)
        else:
            out = programs.dataset_analysis(ratings, args.threshold, args.limit)
    if args.out:
        text.write_table(out, f"{args.out}/{args.command}")
    return out


if __name__ == "__main__":
    found = main(sys.argv[1:])
    if found is not None:
        found.show(100, truncate=False)
