from collections import defaultdict

import pytest
from tests.conftest import SF

from feedloop.operators import neighbours as K
from feedloop.plans import library


def test_every_rated_item_votes(spark):
    """Against brute force: all items of a query user have neighbours, and each such user gets rows."""
    m = library._m(spark, SF).collect()
    by_item, own = defaultdict(dict), defaultdict(dict)
    for r in m:
        by_item[r["i"]][r["u"]] = r["r"]
        if r["u"] % library.EVERY == 0:
            own[r["u"]][r["i"]] = r["r"]
    norm = {i: sum(x * x for x in us.values()) ** 0.5 for i, us in by_item.items()}

    def near(a):
        sims = []
        for b, us in by_item.items():
            common = by_item[a].keys() & us.keys()
            if b != a and common:
                sims.append((-round(sum(by_item[a][u] * us[u] for u in common) / (norm[a] * norm[b]), 9), b))
        return sorted(sims)[:10]

    expected = {}
    for u, items in own.items():
        scores = defaultdict(float)
        for a, value in items.items():
            for sim, b in near(a):
                if b not in items:
                    scores[b] -= sim * value
        expected |= {(u, b): s for b, s in scores.items()}
    got = library.QUERIES["itemknn_scores"](spark, SF).collect()
    assert got and {r["u"] for r in got} == {u for u, _ in expected}
    for r in got:
        assert r["score"] == pytest.approx(expected[r["u"], r["i"]], abs=1e-5)
        higher = [b for (u, b), s in expected.items() if u == r["u"] and s > r["score"] + 1e-5]
        assert len(higher) < r["place"] <= 10


@pytest.mark.parametrize("dense", [20_000, 2])
def test_nearest_of_all(spark, monkeypatch, dense):
    monkeypatch.setattr(K, "DENSE", dense)
    rows = [(i, u, float(1 + (u * i) % 5)) for u in range(30) for i in range(u % 4, 40, 1 + u % 3)]
    state = spark.createDataFrame(rows, "k int, i int, r double")
    same = lambda df: sorted((r["a"], r["b"], round(r["sim"], 9), r["place"]) for r in df.collect())
    assert same(K.nearest_of_all(state, 3)) == same(K.nearest(K.cosine(state, state), 3))
    assert K.nearest_of_all(state.limit(0), 3).count() == 0
