"""Delimited files, run files and graphs, read to and written from DataFrames. Compressed files (.gz) are read alike."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_COLUMNS = {"long": "bigint", "int": "int", "string": "string"}


#: Bits of a line's number within its file.
_IN_FILE = 43


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(seq, value)``: the lines of all files, numbered in the order of (file name, place in the file).

    Spark packs files into tasks by size, so the order of tasks is not that of files. A line's number is made of its
    file's place among the names, where its split of the file begins, and its place in the split, which stays below the
    split's bytes. One row for each split is broadcast; the lines themselves aren't moved.
    """
    where = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id")]
    splits = spark.read.text(path).select(*where).groupBy("_file", "_start").agg(F.min("_id").alias("_first"))
    splits = splits.withColumn("_no", F.dense_rank().over(Window.orderBy("_file")).cast("bigint") - 1)  # a row for each split
    rows = spark.read.text(path).select("value", *where).join(F.broadcast(splits), ["_file", "_start"])
    return rows.select((F.shiftleft("_no", _IN_FILE) + F.col("_start") + F.col("_id") - F.col("_first")).alias("seq"), "value")


def _fields(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``(seq, f)``: the fields of every line that isn't blank; seq follows the order of the lines."""
    return lines(spark, path).where(F.trim("value") != "").select("seq", F.split("value", "\\Q" + sep + "\\E", -1).alias("f"))


def ratings(spark: SparkSession, path: str, sep: str = "::", user: str = "long", item: str = "long") -> DataFrame:
    """``(seq, user, item, rating)``; further fields are ignored. A line that doesn't parse raises."""
    f = _fields(spark, path, sep)
    return f.select("seq", F.col("f")[0].cast(_COLUMNS[user]).alias("user"), F.col("f")[1].cast(_COLUMNS[item]).alias("item"), F.col("f")[2].cast("double").alias("rating"))


def knowledge(spark: SparkSession, path: str, sep: str = "::") -> DataFrame:
    """``(seq, user, item, rating, known)``; known where the fourth field is 1."""
    f = _fields(spark, path, sep)
    return f.select(
        "seq", F.col("f")[0].cast("bigint").alias("user"), F.col("f")[1].cast("bigint").alias("item"), F.col("f")[2].cast("double").alias("rating"),
        (F.col("f")[3] == "1").alias("known"),
    )


def contacts(spark: SparkSession, path: str, directed: bool, sep: str = "\t") -> DataFrame:
    """``(src, dst)`` without self-loops and repetitions; undirected edges come both ways."""
    f = _fields(spark, path, sep).select(F.col("f")[0].cast("bigint").alias("src"), F.col("f")[1].cast("bigint").alias("dst")).where("src <> dst")
    return (f if directed else f.unionByName(f.select(F.col("dst").alias("src"), F.col("src").alias("dst")))).distinct()


def graph(spark: SparkSession, path: str, weights: bool = True, types: bool = False, loops: bool = False, nodes: DataFrame | None = None, sep: str = "\t") -> DataFrame:
    """``(src, dst, weight, type)``; weight 1 and type 0 where they aren't read. nodes ``(v)``: only edges among them."""
    f = _fields(spark, path, sep)
    edges = f.select(
        F.col("f")[0].cast("bigint").alias("src"), F.col("f")[1].cast("bigint").alias("dst"),
        (F.col("f")[2].cast("double") if weights else F.lit(1.0)).alias("weight"),
        (F.col("f")[2 + weights].cast("int") if types else F.lit(0)).alias("type"),
    )
    edges = edges if loops else edges.where("src <> dst")
    if nodes is not None:
        edges = edges.join(nodes.select(F.col("v").alias("src")), "src", "left_semi").join(nodes.select(F.col("v").alias("dst")), "dst", "left_semi")
    return edges.select("src", "dst", "weight", "type")


def log(spark: SparkSession, path: str, single: bool = False, sep: str = "\t") -> DataFrame:
    """``(seq, u, i, reward, cands)``: user, featured item, reward and candidates, which are a set that holds the
    featured item; single: it is the only one. Lines with fewer than three fields are left out."""
    f = _fields(spark, path, sep).where("size(f) >= 3")
    item = F.col("f")[1].cast("int")
    listed = F.transform(F.slice("f", 4, F.greatest(F.size("f") - 3, F.lit(0))), lambda x: x.cast("int"))
    cands = F.array(item) if single else F.array_union(listed, F.array(item))
    return f.select("seq", F.col("f")[0].cast("int").alias("u"), item.alias("i"), F.col("f")[2].cast("double").alias("reward"), cands.alias("cands"))


def index(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """``(id, code)`` of an index file; codes follow the order of the lines."""
    from feedloop.operators.prefix import sums_before

    ids = lines(spark, path).where(F.trim("value") != "").select(F.col("seq").alias("_seq"), F.col("value").cast(_COLUMNS[kind]).alias("id"), F.lit(1).alias("_n"))
    return sums_before(ids, ["_seq"], "_n").select("id", F.col("_before").cast("int").alias("code"))


def seeds(spark: SparkSession, path: str) -> list[int]:
    return [int(r[0]) for r in spark.read.text(path).where(F.trim("value") != "").collect()]


RUN = "iter int, u int, i int, time bigint"


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """``(iter, u, i, time, rank, score)`` of a text run file with a header. Rows of one iter are a ranking of n items,
    and the one at place k (from 0) scores (n - k) / n. Of a torn last line, nothing is kept."""
    rows = lines(spark, path).withColumnRenamed("seq", "_seq").select("_seq", F.split("value", "\t", -1).alias("f"))
    good = (F.size("f") == 4) & F.col("f")[0].rlike(r"^\d+$") & F.col("f")[3].rlike(r"^\d+$")
    rows = rows.where(good).select("_seq", *(F.col("f")[k].cast(t).alias(n) for k, (n, t) in enumerate((("iter", "int"), ("u", "int"), ("i", "int"), ("time", "bigint")))))
    own = Window.partitionBy("iter")
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy("_seq"))).withColumn("_n", F.count("*").over(own))
    return rows.withColumn("score", (F.col("_n") - F.col("rank") + 1) / F.col("_n")).select("iter", "u", "i", "time", "rank", "score")


def write_run(df: DataFrame, path: str, compressed: bool = False) -> None:
    """A text run file: header, then a tab-separated row for each item, in the order of iter and rank."""
    rows = df.orderBy("iter", "rank").select(F.col("iter").alias("numIter"), F.col("u").alias("uidx"), F.col("i").alias("iidx"), "time")
    rows.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip" if compressed else "none").csv(path)


def write_runs(runs: DataFrame, path: str, compressed: bool = False) -> None:
    """Text run files of many runs ``(run, seed, iter, rank, u, i, time)``, one in each folder ``run=.../seed=...``."""
    rows = runs.repartition("run", "seed").sortWithinPartitions("run", "seed", "iter", "rank")
    rows = rows.select("run", "seed", F.col("iter").alias("numIter"), F.col("u").alias("uidx"), F.col("i").alias("iidx"), "time")
    rows.write.mode("overwrite").partitionBy("run", "seed").option("sep", "\t").option("header", True).option("compression", "gzip" if compressed else "none").csv(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """``(run, seed, iter, rank, u, i, time)`` of a folder of run files that write_runs wrote."""
    rows = spark.read.option("sep", "\t").option("header", True).schema("numIter int, uidx int, iidx int, time bigint, run string, seed int").csv(path)
    rows = rows.select("run", "seed", F.col("numIter").alias("iter"), F.col("uidx").alias("u"), F.col("iidx").alias("i"), "time", F.monotonically_increasing_id().alias("_at"))
    place = Window.partitionBy("run", "seed", "iter").orderBy("_at")  # a ranking's rows lie together in one file
    return rows.where("iter IS NOT NULL").withColumn("rank", F.row_number().over(place)).drop("_at")


def read_binary_run(spark: SparkSession, path: str) -> DataFrame:
    """``(iter, u, i, time, rank)`` of a binary run file: big-endian int iter, int user, int n, n int items, long time.
    A file is one record stream and is read as a whole; many files are read side by side."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                out, at = [], 0
                while at + 12 <= len(raw):
                    step, user, n = struct.unpack_from(">iii", raw, at)
                    if at + 20 + 4 * n > len(raw):
                        break
                    items = struct.unpack_from(f">{n}i", raw, at + 12)
                    (time,) = struct.unpack_from(">q", raw, at + 12 + 4 * n)
                    out += [(step, user, i, time, k) for k, i in enumerate(items, 1)]
                    at += 20 + 4 * n
                if out:
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["iter", "u", "i", "time", "rank"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, f"{RUN}, rank int")


def binary_run(df: DataFrame) -> DataFrame:
    """``(iter, record)``: each iteration of a run as one record of the binary format, in bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)
            records = [struct.pack(f">iii{len(items)}iq", step, user, len(items), *items, time) for step, user, time, items in rows]
            yield pa.record_batch([b.column(0), pa.array(records, pa.binary())], names=["iter", "record"])

    lists = df.groupBy("iter").agg(F.first("u").alias("u"), F.max("time").alias("time"), F.array_sort(F.collect_list(F.struct("rank", "i"))).alias("l"))
    return lists.select("iter", "u", "time", F.transform("l", lambda x: x["i"]).alias("items")).mapInArrow(pack, "iter int, record binary")


def write_graph(edges: DataFrame, path: str, weights: bool = True, types: bool = False) -> None:
    columns = ["src", "dst", *["weight"] * weights, *["type"] * types]
    edges.select(*columns).write.mode("overwrite").option("sep", "\t").csv(path)


def write_table(df: DataFrame, path: str) -> None:
    """A small tab-separated report with a header: a ranking, or a summary."""
    df.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def _tagged(parts: Column, tag: str) -> Column:
    return F.element_at(F.filter(parts, lambda x: x.startswith(tag + " ")), 1)


def news_log(spark: SparkSession, path: str, features: int = 136) -> DataFrame:
    """``(seq, ts, item, reward, user, cands)`` of a news-feed log: ``time item click |user f.. |item f.. |item f..``.

    The user is a string of 0 and 1 over features 2 to features - 1; users with none of them are left out.
    """
    from feedloop.functions.scores import one_hot

    parts = lines(spark, path).select("seq", F.transform(F.split("value", r"\|"), F.trim).alias("p"))
    head = F.split(F.col("p")[0], r"\s+")
    codes = F.transform(F.filter(F.split(_tagged(F.col("p"), "user"), r"\s+"), lambda x: x.rlike(r"^\d+(:.*)?$")), lambda x: F.split(x, ":")[0].cast("int"))
    shown = F.transform(F.filter(F.slice("p", 2, 10_000), lambda x: ~x.startswith("user")), lambda x: F.split(x, r"\s+")[0])
    rows = parts.select("seq", head[0].cast("bigint").alias("ts"), head[1].alias("item"), head[2].cast("double").alias("reward"), one_hot(codes, 2, features - 1).alias("user"), shown.alias("cands"))
    return rows.where(F.col("user").contains("1"))
