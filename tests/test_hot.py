from pyspark.sql import functions as F

from feedloop.operators import curves, graph, hot
from feedloop.operators.neighbours import co_ratings


def test_split_join_equals_a_join(spark):
    left = spark.createDataFrame([(k, k % 5) for k in range(40)] + [(99, None)], "a int, k int")
    right = spark.createDataFrame([(k, 0 if k % 3 else k % 7) for k in range(300)] + [(999, None)], "b int, k int")
    plain = sorted(tuple(r) for r in left.join(right, "k").select("k", "a", "b").collect())
    for share in (1, 10, 10**6):
        assert sorted(tuple(r) for r in hot.split_join(left, right, "k", share).select("k", "a", "b").collect()) == plain
    assert hot.split_join(left.limit(0), right, "k", 1).count() == 0 and hot.split_join(left, right.limit(0), "k", 1).count() == 0


def test_co_ratings_with_a_hot_item(spark, monkeypatch):
    state = spark.createDataFrame([(u, i, 1.0) for u in range(30) for i in range(4) if i == 0 or (u + i) % 3], "k int, i int, r double")
    expected = {tuple(r) for r in co_ratings(state.where("k < 4"), state).collect()}
    monkeypatch.setattr(hot.split_join, "__defaults__", (5,))
    assert {tuple(r) for r in co_ratings(state.where("k < 4"), state).collect()} == expected and len(expected) == 4 * 29


def test_frequencies_by_differences(spark):
    rows = [("a", k, (k * k) % 5) for k in range(1, 41)] + [("b", k, 0) for k in range(1, 8)]
    runs = curves.with_iterations(spark.createDataFrame(rows, "run string, seq bigint, i int"))
    got = {(r["run"], r["point"], r["freq"]): r["m"] for r in curves.frequencies(runs, 4).collect()}
    expected = {}
    for run in "ab":
        items = [i for r, _, i in rows if r == run]
        for point in {min(p, len(items)) for p in range(4, len(items) + 4, 4)}:
            seen = items[:point]
            for i in set(seen):
                key = (run, point, seen.count(i))
                expected[key] = expected.get(key, 0) + 1
    assert got == expected


def test_popularity_before(spark):
    rows = [("a", 1, 5), ("a", 2, 5), ("a", 3, 6), ("b", 4, 5), ("a", 9, 5)]
    got = curves.popularity_before(spark.createDataFrame(rows, "run string, seq bigint, i int")).orderBy("seq")
    assert [r["before"] for r in got.collect()] == [0, 1, 0, 0, 2]


def test_graphs_change(spark):
    e = spark.createDataFrame([(1, 2, 1.0, 0), (2, 1, 2.0, 0), (2, 3, 1.0, 0), (4, 4, 1.0, 0)], "src bigint, dst bigint, weight double, type int")
    assert tuple(graph.reciprocity(e).first()) == (4, 2, 0.5) and tuple(graph.reciprocity(e.limit(0)).first()) == (0, 0, None)
    new = spark.createDataFrame([(3, 2, 9.0, 1), (3, 2, 9.0, 1), (2, 3, 9.0, 1)], e.schema)
    assert {(r["src"], r["dst"], r["weight"]) for r in graph.add_edges(e, new).collect()} == {(1, 2, 1.0), (2, 1, 2.0), (2, 3, 1.0), (4, 4, 1.0), (3, 2, 9.0)}
    assert graph.remove_edges(e, spark.createDataFrame([(1, 2), (7, 7)], "src bigint, dst bigint")).count() == 3
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5)], "v bigint")
    assert graph.complete_edges(nodes, nodes.where("v < 3")).count() == 8
    assert [r["v"] for r in graph.sources(e, nodes).collect()] == [] and [r["v"] for r in graph.sinks(e, nodes).collect()] == [3] and [r["v"] for r in graph.isolated(e, nodes).collect()] == [5]
    drawn = [{tuple(r) for r in graph.random_edges(20, 0.3, 7, False, spark).collect()} for _ in range(2)]
    assert drawn[0] == drawn[1] and len(drawn[0]) == 57 and all(a < b for a, b in drawn[0])
