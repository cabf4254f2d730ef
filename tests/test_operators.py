import math
import random

import pytest
from pyspark.sql import functions as F

from feedloop.functions import scores as S
from feedloop.operators import curves as C
from feedloop.operators import graph as G
from feedloop.operators import preferences as P
from feedloop.operators import splits as D
from feedloop.operators.prefix import dense_codes, running

#: Frequencies of all items, and their Gini index.
VECTORS = [
    ([1, 0, 0], 1), ([2, 0, 0], 1), ([3, 0, 0], 1), ([3, 1, 0], 3 / 4), ([3, 2, 0], 3 / 5), ([3, 2, 1], 1 / 3), ([2, 2, 1], 1 / 5), ([2, 1, 1], 1 / 4),
    ([1, 1, 1], 0), ([1, 1, 0], 1 / 2), ([2, 2, 3, 4], 7 / 33), ([4, 2, 3, 4], 7 / 39), ([5, 2, 3, 4], 5 / 21), ([2, 2, 3, 0], 3 / 7), ([2, 2, 3, 5], 5 / 18),
    ([5, 2, 3, 5], 11 / 45), ([1, 2, 3, 5], 13 / 33), ([1000, 0, 0, 0], 1),
]


def test_gini_vectors(spark):
    rows = [(k, f, 1) for k, (v, _) in enumerate(VECTORS) for f in v]
    freqs = spark.createDataFrame(rows, "k int, freq bigint, m bigint").where("freq > 0").groupBy("k", "freq").agg(F.sum("m").alias("m"))
    n = F.element_at(F.array(*(F.lit(len(v)) for v, _ in VECTORS)), F.col("k") + 1)
    got = {r["k"]: r["gini"] for r in C.gini(freqs, n, ["k"]).collect()}
    for k, (_, expected) in enumerate(VECTORS):
        assert got[k] == pytest.approx(expected, abs=1e-4)


def test_gini_of_nothing(spark):
    none = spark.createDataFrame([], "k int, freq bigint, m bigint")
    assert C.gini(none, F.lit(3), ["k"]).count() == 0
    one = spark.createDataFrame([(0, 5, 1)], "k int, freq bigint, m bigint")
    assert C.gini(one, F.lit(1), ["k"]).first()["gini"] is None


def test_curves_against_a_plain_fold(spark):
    rnd = random.Random(1)
    rows = [(k % 2, k, rnd.randint(0, 9), rnd.randint(0, 6), float(rnd.random() < 0.3)) for k in range(500)]
    runs = C.with_iterations(spark.createDataFrame(rows, "run int, seq bigint, u int, i int, reward double"))
    got = {(r["run"], r["point"]): r for r in C.cumulative(runs, {"hits": F.col("reward")}, 70).collect()}
    freq = {}
    for r in C.frequencies(runs, 70).collect():
        freq.setdefault((r["run"], r["point"]), {})[r["freq"]] = r["m"]
    last = {}
    for r in C.last_frequencies(runs, 70, 100).collect():
        last.setdefault((r["run"], r["point"]), {})[r["freq"]] = r["m"]
    for run in (0, 1):
        own = [r for r in rows if r[0] == run]
        for point in [*range(70, 251, 70), 250]:
            assert got[run, point]["hits"] == sum(r[4] for r in own[:point])
            for window, found in ((own[:point], freq), (own[max(0, point - 100) : point], last)):
                count = [sum(r[3] == i for r in window) for i in range(7)]
                assert found[run, point] == {f: count.count(f) for f in set(count) if f}


def test_running_sums_over_blocks(spark):
    rows = [(1, k, k) for k in range(1, 300)] + [(2, 10, 5), (2, None, 7)]
    out = running(spark.createDataFrame(rows, "p int, o bigint, v bigint"), ["p"], "o", {"s": F.col("v")}, block=16)
    got = {(r["p"], r["o"]): r["s"] for r in out.collect()}
    assert got == {(1, k): k * (k + 1) // 2 for k in range(1, 300)} | {(2, 10): 5}


def test_dense_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "id string")
    assert {r["id"]: r["code"] for r in dense_codes(df, "id").collect()} == {"a": 0, "b": 1, "c": 2}


def test_merges_and_views(spark):
    x = spark.createDataFrame([(1, 1, 1, 2.0, True), (2, 1, 1, 5.0, False), (3, 1, 1, 3.0, False)], "seq bigint, u int, i int, r double, known boolean")
    assert [P.merge(x, p).first()["r"] for p in ("basic", "last", "best", "additive")] == [2.0, 3.0, 5.0, 10.0]
    assert P.view(x, "known").count() == 1 and P.view(x, "unknown").count() == 2 and P.view(x, "all").count() == 3
    with pytest.raises(ValueError, match="no such view"):
        P.view(x, "some")
    pairs = spark.createDataFrame([(1, 2)], "u int, i int")
    state = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, 3, 1.0)], "u int, i int, r double")
    assert P.restrict(state, pairs).count() == 1 and P.restrict(state, pairs, both_ways=True).count() == 2
    assert P.reveal(spark.createDataFrame([(9, 9)], "u int, i int"), state).first()["r"] is None


def test_missing_rating_is_never_relevant(spark):
    df = spark.createDataFrame([(None,), (4.0,), (1.0,)], "r double")
    assert [r[0] for r in df.select(P.is_relevant(F.col("r"), 4.0)).collect()] == [False, True, False]


def test_score_expressions(spark):
    row = spark.createDataFrame([([1.0, 0.0, 1.0], [3, 5])], "y array<double>, f array<int>")
    got = row.select(S.moving(F.col("y"), 0.5), S.one_hot(F.col("f"), 2, 6), S.sigmoid(F.lit(0.0)), S.dot(F.col("y"), F.col("y"))).first()
    assert tuple(got) == (0.625, "01010", 0.5, 2.0)


def test_splits(spark):
    log = spark.createDataFrame([(k, k % 3 == 0) for k in range(1, 24)], "seq bigint, rel boolean")
    ends = {r["part"]: r["e"] for r in D.uniform(log, "seq", 4).groupBy("part").agg(F.max("place").alias("e")).collect()}
    assert ends == {p: 23 * (p + 1) // 4 for p in range(4)}
    relevant = {r["part"]: r["end"] for r in D.by_relevant(log, "seq", F.col("rel"), 3).collect()}
    places = [k for k in range(1, 24) if k % 3 == 0]
    assert relevant == {c: places[math.ceil(7 * c / 3) - 1] for c in (1, 2, 3)}
    assert D.first_percent(log, "seq", 0.5).count() == 11


def _union_find(edges, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 199), rnd.randint(0, 199)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)]
    nodes = list(range(400))
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    v = spark.createDataFrame([(n,) for n in nodes], "v bigint")
    assert {r["v"]: r["component"] for r in G.components(e, v).collect()} == _union_find(edges, nodes)
    assert {r["component"] for r in G.components(e.limit(0), v.limit(3)).collect()} == {0, 1, 2}


def test_graph_lookups(spark):
    lines = spark.createDataFrame([(1, 1, 2, None, 4), (2, 1, 2, 9.0, 5), (3, 2, 1, 3.0, 0), (4, 3, 3, 1.0, 0)], "line_id bigint, node_a bigint, node_b bigint, weight double, types int")
    e = G.from_edges(lines)
    assert sorted(map(tuple, e.collect())) == [(1, 2, 1.0, 4), (2, 1, 3.0, 0)]
    assert G.from_edges(lines, loops=True).count() == 3
    pairs = spark.createDataFrame([(1, 2), (5, 6)], "src bigint, dst bigint")
    assert {(r["src"], r["weight"]) for r in G.lookup(e, pairs).collect()} == {(1, 1.0), (5, None)}
    assert sorted((r["src"], r["dst"], r["weight"]) for r in G.undirected(e).collect()) == [(1, 2, 1.0), (2, 1, 1.0)]
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "v bigint")
    assert sorted(tuple(r) for r in G.complement_edges(e, nodes, nodes.where("v = 1")).collect()) == [(1, 3)]


@pytest.mark.parametrize("directed", [True, False])
def test_random_graph(spark, directed):
    out = [tuple(r) for r in G.random_edges(20, 0.3, 7, directed, spark).collect()]
    assert len(out) == len(set(out)) == math.ceil(0.3 * 20 * 19 / (1 if directed else 2))
    assert all(0 <= a < 20 and 0 <= b < 20 and a != b for a, b in out) and (directed or all(a < b for a, b in out))
    assert {tuple(r) for r in G.random_edges(6, 1.0, 7, False, spark).collect()} == {(a, b) for a in range(6) for b in range(a + 1, 6)}


def test_matched_prefix(spark):
    from feedloop.operators.logs import matched_prefix

    log = spark.createDataFrame([(5, 1, 1, 1.0), (7, 1, 2, 0.0), (9, 2, 2, 1.0)], "seq bigint, u int, i int, reward double")
    train = spark.createDataFrame([(1, 1, 1), (2, 9, 2), (3, 2, 2)], "seq bigint, u int, i int")
    assert sorted(r["place"] for r in matched_prefix(log, train).collect()) == [1, 3]


def test_samples_don_t_depend_on_partitions(spark):
    from feedloop.functions import sampling

    df = spark.range(50)
    cols = [sampling.beta(F.col("id"), F.lit(2), F.lit(5), 1).alias("b"), sampling.gamma(F.col("id"), F.lit(0), F.lit(1), 1).alias("g"), sampling.uniform(F.col("id"), 1).alias("u")]
    one, many = (sorted(map(tuple, df.repartition(n).select("id", *cols).collect())) for n in (1, 5))
    assert one == many and all(0 < b < 1 and g == 0 and 0 <= u < 1 for _, b, g, u in one) and len({b for _, b, _, _ in one}) == 50
