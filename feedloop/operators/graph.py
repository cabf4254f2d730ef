"""Graphs as edge tables ``(src, dst, weight, type)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloop.operators.prefix import sums_before
from feedloop.operators.tiles import distances_in_common, over_tiles, pairs_in_common
from feedloop.session import cut


def from_edges(edges: DataFrame, loops: bool = False) -> DataFrame:
    """The graph of typed lines ``(line_id, node_a, node_b, weight, types)``: of lines with the same ends the first
    counts; without a weight it is 1; self-loops are dropped unless asked for."""
    rows = edges if loops else edges.where("node_a <> node_b")
    first = F.min_by(F.struct(F.coalesce("weight", F.lit(1.0)).alias("weight"), F.col("types").alias("type")), "line_id")
    return rows.groupBy(F.col("node_a").alias("src"), F.col("node_b").alias("dst")).agg(first.alias("_e")).select("src", "dst", "_e.weight", "_e.type")


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge in both orientations; where both exist, the weight of the one from the lesser node counts."""
    ends = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight", "type", (F.col("src") > F.col("dst")).alias("_back"))
    one = ends.groupBy("a", "b").agg(F.min_by(F.struct("weight", "type"), "_back").alias("_e")).select("a", "b", "_e.weight", "_e.type")
    back = one.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight", "type")
    return one.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight", "type").unionByName(back.where("src <> dst"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).unionByName(edges.select(F.col("dst").alias("v"))).distinct()


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(v, in_degree, out_degree, degree)`` of all nodes; degree is their sum."""
    ends = edges.select(F.col("src").alias("v"), F.lit(1).alias("_out"), F.lit(0).alias("_in")).unionByName(
        edges.select(F.col("dst").alias("v"), F.lit(0).alias("_out"), F.lit(1).alias("_in"))
    )
    count = ends.groupBy("v").agg(F.sum("_in").alias("in_degree"), F.sum("_out").alias("out_degree"))
    out = nodes.join(count, "v", "left").na.fill(0, ["in_degree", "out_degree"])
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def mutual(edges: DataFrame) -> DataFrame:
    """``(src, dst, adjacent, incident, average)`` of edges that exist both ways: the weights of either and their mean."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("incident"))
    both = edges.select("src", "dst", F.col("weight").alias("adjacent")).join(back, ["src", "dst"])
    return both.withColumn("average", (F.col("adjacent") + F.col("incident")) / 2)


def _ends(edges: DataFrame, nodes: DataFrame, out: bool, into: bool) -> DataFrame:
    """Nodes with and without edges out and in, from one aggregation of the edges."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(True).alias("_out")), F.struct(F.col("dst").alias("v"), F.lit(False).alias("_out")))).alias("_e")
    per = edges.select(ends).select("_e.*").groupBy("v").agg(F.max("_out").alias("_out"), F.max(~F.col("_out")).alias("_in"))
    rows = nodes.join(per, "v", "left").where((F.coalesce("_out", F.lit(False)) == out) & (F.coalesce("_in", F.lit(False)) == into))
    return rows.select(*nodes.columns)


def sources(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with edges out and none in."""
    return _ends(edges, nodes, True, False)


def sinks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with edges in and none out."""
    return _ends(edges, nodes, False, True)


def isolated(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return _ends(edges, nodes, False, False)


def reciprocity(edges: DataFrame) -> DataFrame:
    """``(edges, mutual, reciprocity)``: how many edges there are, how many of them exist both ways, and their share."""
    pair = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count_distinct(F.col("src") < F.col("dst")).alias("_ways"))
    loops = edges.where("src = dst").agg(F.count("*").alias("_loops"))
    sums = pair.agg(F.coalesce(F.sum("_ways"), F.lit(0)).alias("edges"), F.coalesce(F.sum(F.when(F.col("_ways") == 2, 2)), F.lit(0)).alias("mutual")).crossJoin(loops)
    total = F.col("edges") + F.col("_loops")
    return sums.select(total.alias("edges"), "mutual", (F.col("mutual") / F.nullif(total, F.lit(0))).alias("reciprocity"))


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """The graph with further edges ``(src, dst, weight, type)``; one that exists already keeps its weight and type."""
    return edges.unionByName(new.dropDuplicates(["src", "dst"]).join(edges, ["src", "dst"], "left_anti").select(*edges.columns))


def remove_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The graph without the edges of these pairs ``(src, dst)``."""
    return edges.join(pairs, ["src", "dst"], "left_anti")


def complete_edges(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """``(src, dst)`` of the complete graph, for the stated query nodes; without loops."""
    return complement_edges(nodes.sparkSession.createDataFrame([], "src bigint, dst bigint"), nodes, queries)


def neighbour_weights(edges: DataFrame) -> DataFrame:
    """``(v, neighbour, weight)``: the weights of the edges between two nodes, either way, added up."""
    both = edges.select(F.col("src").alias("v"), F.col("dst").alias("neighbour"), "weight").unionByName(
        edges.select(F.col("dst").alias("v"), F.col("src").alias("neighbour"), "weight")
    )
    return both.groupBy("v", "neighbour").agg(F.sum("weight").alias("weight"))


def lookup(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``(src, dst)`` with the edge's weight and type; null where there is no edge."""
    return pairs.join(edges, ["src", "dst"], "left")


def without(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """The graph without these nodes ``v`` and their edges."""
    gone_src, gone_dst = removed.select(F.col("v").alias("src")), removed.select(F.col("v").alias("dst"))
    return edges.join(gone_src, "src", "left_anti").join(gone_dst, "dst", "left_anti")


def complement_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(v, missing)``: nodes that each node has no edge to, itself left out. The complement is never built."""
    n = F.broadcast(nodes.agg(F.count("*").alias("_n")))
    out = edges.where("src <> dst").groupBy(F.col("src").alias("v")).agg(F.count("*").alias("_out"))
    return nodes.join(out, "v", "left").crossJoin(n).select("v", (F.col("_n") - 1 - F.coalesce("_out", F.lit(0))).alias("missing"))


def complement_edges(edges: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """``(src, dst)``: for the stated query nodes, every node they have no edge to, themselves left out."""
    wide = queries.select(F.col("v").alias("src")).crossJoin(nodes.select(F.col("v").alias("dst"))).where("src <> dst")
    return wide.join(edges, ["src", "dst"], "left_anti")


def components(edges: DataFrame, nodes: DataFrame, most: int = 60) -> DataFrame:
    """``(v, component)``: the least node that each node is connected with, whatever the edges' direction.

    Labels run along edges and then along labels (pointer jumping), so rounds grow with the logarithm of the longest
    path; each round is checkpointed. A hub's labels are combined before the shuffle.
    """
    both = edges.select(F.col("src").alias("v"), F.col("dst").alias("w")).unionByName(edges.select(F.col("dst").alias("v"), F.col("src").alias("w")))
    both = cut(both.where("v <> w").distinct())
    label = cut(nodes.select("v", F.col("v").alias("c")))
    for _ in range(most):
        near = both.join(label.select(F.col("v").alias("w"), F.col("c").alias("_near")), "w").groupBy("v").agg(F.min("_near").alias("_near"))
        low = label.join(near, "v", "left").select("v", F.col("c").alias("_old"), F.least("c", "_near").alias("c"))
        jump = low.select(F.col("v").alias("c"), F.col("c").alias("_far"))
        new = cut(low.join(jump, "c", "left").select("v", "_old", F.least("c", "_far").alias("c")))
        label = new.select("v", "c")
        if new.where("c <> _old").isEmpty():
            return label.select("v", F.col("c").alias("component"))
    raise RuntimeError("labels still change; raise most")


def random_edges(nodes: int, p: float, seed: int, directed: bool, spark) -> DataFrame:
    """``(src, dst)`` over nodes 0 .. nodes-1 without loops: exactly ceil(p x possible) edges, drawn by a seeded hash."""
    possible = nodes * (nodes - 1) // (1 if directed else 2)
    wanted = -(-int(p * 1_000_000 * possible) // 1_000_000) if p < 1 else possible
    codes = spark.range(possible)
    # Code k stands for a pair; of an undirected graph, the pairs src < dst row by row.
    if directed:
        src, rest = F.floor(F.col("id") / (nodes - 1)), F.col("id") % (nodes - 1)
        pairs = codes.select("id", src.alias("src"), F.when(rest >= src, rest + 1).otherwise(rest).alias("dst"))
    else:
        row = F.floor((F.lit(2.0 * nodes - 1) - F.sqrt(F.lit((2.0 * nodes - 1) ** 2) - 8.0 * F.col("id"))) / 2)
        pairs = codes.select("id", row.alias("src"), (F.col("id") - (row * (2 * nodes - row - 1) / 2).cast("bigint") + row + 1).alias("dst"))
    drawn = pairs.withColumn("_h", F.xxhash64("id", F.lit(seed)))
    # The first `wanted` in the order of the hash, numbered range by range rather than in one task.
    numbered = sums_before(drawn.withColumn("_n", F.lit(1)), ["_h", "id"], "_n")
    return numbered.where(F.col("_before") < wanted).select("src", "dst")


def co_rating_graph(positives: DataFrame, queries: DataFrame, least: int = 2, places: int | None = None) -> DataFrame:
    """``(a, b, common, weight, distance)``: users with at least `least` common relevant items, for the stated query
    users a: weight 1 / (n_a + n_b - 2 common + 1), distance sqrt(n_a + n_b - 2 common), rounded to so many places if wanted.
    Both: ``(u, i)``, a pair once; the queries with all of their rows. Common items are counted in tiles, so that only pairs of
    the result leave a task."""
    kind = positives.schema["u"].dataType.simpleString()
    schema = "a bigint, b bigint, common bigint, weight double, distance double"
    pairs = over_tiles(_ones(queries), _ones(positives), pairs_in_common(least, places), schema, commons=True)
    return pairs if kind == "bigint" else pairs.withColumns({c: F.col(c).cast(kind) for c in ("a", "b")})


def co_rating_density(positives: DataFrame, queries: DataFrame, least: int = 2, most: int = 11) -> DataFrame:
    """``(least, edges, mean_distance)`` of co_rating_graph as the least number of common items grows from least to most; its pairs
    are summed up where they are found."""
    sums = over_tiles(_ones(queries), _ones(positives), distances_in_common(least, most), "common bigint, edges bigint, distance double", commons=True)
    wide = sums.withColumn("least", F.explode(F.sequence(F.lit(least).cast("bigint"), F.col("common"))))
    return wide.groupBy("least").agg(F.sum("edges").alias("edges"), (F.sum("distance") / F.sum("edges")).alias("mean_distance"))


def _ones(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("k"), "i", F.lit(1.0).alias("r"))


def adjacency(edges: DataFrame, block: int = 1000) -> DataFrame:
    """``(src, part, neighbours, weights)``: rows of the adjacency matrix, sparse and sorted by neighbour; a node with
    many neighbours has several parts of at most `block`, so a hub's row is never one value."""
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    parts = edges.withColumn("part", F.floor((place - 1) / block).cast("int"))
    lists = parts.groupBy("src", "part").agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("l"))
    return lists.select("src", "part", F.transform("l", lambda x: x["dst"]).alias("neighbours"), F.transform("l", lambda x: x["weight"]).alias("weights"))
