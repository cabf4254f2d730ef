from itertools import islice

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloop.functions import distributions as D
from feedloop.functions import sampling, sequences
from feedloop.operators import curves
from feedloop.policies.loop import Available, RoundRobin, run
from feedloop.policies.registry import Spec
from tests.test_loops import _data


def test_distributions():
    x = (np.arange(20_000) + 0.5) / 20_000
    for a, b in ((2.0, 5.0), (1.0, 1.0), (0.7, 3.0)):
        density = D.Beta(a, b).density(x)
        assert density.mean() == pytest.approx(1, abs=0.02) and (x * density).mean() == pytest.approx(D.Beta(a, b).mean(), abs=0.01)
    y = x * 60
    assert 60 * D.Gamma(3.0, 2.0).density(y).mean() == pytest.approx(1, abs=0.01) and 60 * (y * D.Gamma(3.0, 2.0).density(y)).mean() == pytest.approx(6, abs=0.01)
    assert D.Beta(1, 1).update(3, 1).mean() == pytest.approx(4 / 6) and D.Gamma(2.0, 1.0).update(1, 2).mean() == pytest.approx(2)
    assert D.Beta(2, 2).density(1.5) == 0 and D.Gamma(0.0, 1.0).mean() == 0 and D.Gamma(-1.0).density(1.0) == 0


@pytest.mark.parametrize(("a", "b"), [(2.0, 5.0), (0.4, 0.9), (40.0, 3.0)])
def test_samples_have_their_moments(a, b):
    keys = np.arange(40_000)
    n = len(keys)
    s = D.Beta(np.full(n, a), np.full(n, b)).sample(sampling._uniforms(keys, 3))
    assert s.mean() == pytest.approx(a / (a + b), abs=0.01) and s.var() == pytest.approx(a * b / ((a + b) ** 2 * (a + b + 1)), rel=0.06)
    g = D.Gamma(np.full(n, a), 2.0).sample(sampling._uniforms(keys, 4))
    assert g.mean() == pytest.approx(2 * a, rel=0.03) and g.var() == pytest.approx(4 * a, rel=0.08)


def test_sequences(spark):
    s = sequences.Sequence(3, 2)
    assert list(islice(s, 3)) == [3, 5, 7] and (s.reset() or next(s)) == 3 and (s.reset(9) or next(s)) == 9
    assert next(sequences.KINDS["string"]()) == "0" and isinstance(next(sequences.KINDS["double"]()), float)
    assert [r["value"] for r in sequences.table(spark, 3, 1, 5, "string").orderBy("place").collect()] == ["1", "6", "11"]


def test_own_metrics(spark):
    runs = curves.with_iterations(spark.createDataFrame([("a", k, k % 3, float(k % 2)) for k in range(10)], "run string, seq bigint, i int, r double"))
    rate = curves.Metric("rate", {"hits": F.col("r"), "all": F.lit(1)}, F.col("hits") / F.col("all"))
    most = curves.Metric("zeros", {"all": F.when(F.col("i") == 0, 1)}, F.col("all"))
    got = [(r["point"], r["rate"], r["zeros"]) for r in curves.curve(runs, [rate, most], 4).orderBy("point").collect()]
    assert got == [(4, 0.5, 2), (8, 0.5, 3), (10, 0.5, 4)]


def test_own_strategies():
    data = _data()

    class Last(Available):
        def next(self):
            found = super().next()
            return found and (found[0], found[1][-2:])

    greedy = Spec("g", "itembandit-epsilon", {"epsilon": 0.0, "step": lambda old, value, n, alpha: max(old, value)})
    out = list(run(greedy.build(12, 9, 1, "id"), data, 1, lambda done, hits: done >= 7, selection=Last, users=RoundRobin))
    assert [x[2] for x in out] == list(range(7)) and all(x[3] >= 7 for x in out)
    seldom = Spec("s", "average", {"value_function": lambda user, items, scores, times: -times}).build(12, 9, 1, "id")
    for item in (0, 0, 1):
        seldom.update(0, item, 1.0)
    assert seldom.pick(0, np.array([0, 1])) == 1 and seldom.pick(0, np.array([0, 1, 2])) == 2
