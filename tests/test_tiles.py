import numpy as np
import pytest

from feedloop.operators import graph, tiles
from feedloop.operators import neighbours as K

ROWS = [(u, i, 0.5 * (1 + (u * i) % 10)) for u in range(60) for i in range(u % 4, 40, 1 + u % 7)] + [(60, 0, 5.0), (61, 99, 5.0)]


@pytest.fixture
def small(monkeypatch):
    """Several tiles, blocks of queries and slices of products."""
    for name, value in (("CELLS", 40), ("QUERIES", 7), ("SPREAD", 5), ("DENSE", 3), ("PARTS", 3)):
        monkeypatch.setattr(tiles, name, value)


def _common(rows):
    own = {}
    for u, i, _ in rows:
        own.setdefault(u, set()).add(i)
    return {(a, b): (n, len(own[a]) + len(own[b]) - 2 * n) for a in own if a % 3 == 0 for b in own if a != b and (n := len(own[a] & own[b])) > 1}


def test_co_rating_density_sums_where_pairs_are_found(spark, small):
    liked = spark.createDataFrame([(u, i) for u, i, _ in ROWS], "u int, i int")
    got = graph.co_rating_density(liked, liked.where("u % 3 = 0"))
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan  # no pair of users is joined or shuffled
    pairs = _common(ROWS).values()
    expected = {k: [apart**0.5 for n, apart in pairs if n >= k] for k in range(2, 12)}
    for r in (rows := got.collect()):
        assert r["edges"] == len(expected[r["least"]]) and r["mean_distance"] == pytest.approx(np.mean(expected[r["least"]]))
    assert {r["least"] for r in rows} == {k for k, v in expected.items() if v}
    assert graph.co_rating_density(liked, liked.limit(0)).count() == 0 and graph.co_rating_density(liked.limit(0), liked).count() == 0


def test_co_rating_graph_in_tiles(spark, small):
    liked = spark.createDataFrame([(u, i) for u, i, _ in ROWS], "u int, i int")
    for places in (None, 6):
        got = graph.co_rating_graph(liked, liked.where("u % 3 = 0"), places=places)
        assert "Join" not in got._jdf.queryExecution().toString()
        exact = {(r["a"], r["b"]): (r["common"], r["weight"], r["distance"]) for r in got.collect()}
        apart = {(a, b): (n, 1 / (d + 1), d**0.5) for (a, b), (n, d) in _common(ROWS).items()}
        assert exact == (apart if places is None else {k: (n, round(w, 6), round(d, 6)) for k, (n, w, d) in apart.items()})
    assert tiles._rounded(np.array([1 / 128, 1 / 640]), 6).tolist() == [0.007813, 0.001563]


@pytest.mark.parametrize("kind", ["cosine", "restricted", "beta"])
def test_nearest_in_tiles(spark, small, kind):
    state = spark.createDataFrame(ROWS, "k int, i int, r double")
    queries = state.where("k % 3 = 0")
    plain = {"cosine": K.cosine, "restricted": K.restricted_cosine, "beta": lambda q, s: K.beta_exact(q, s, 1.0, 2.0)}[kind](queries, state)
    got = K.nearest_to(queries, state, kind, 4)
    assert got.schema["a"].dataType == state.schema["k"].dataType and "Join" not in got._jdf.queryExecution().toString()
    same = lambda df: sorted((r["a"], r["b"], round(r["sim"], 9), r["place"]) for r in df.collect())
    assert (rows := same(got)) == same(K.nearest(plain, 4)) and len(rows) > 70
    assert K.nearest_to(queries.limit(0), state, kind, 4).count() == 0
