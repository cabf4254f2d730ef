import numpy as np
import pytest

from feedloop.policies.neighbours import Table
from feedloop.policies.registry import Spec

RNG = np.random.default_rng(5)
FACTS = [(int(u), int(i), float(v)) for u, i, v in zip(RNG.integers(0, 40, 300), RNG.integers(0, 12, 300), RNG.random(300) * (RNG.random(300) < 0.7), strict=True)]


@pytest.mark.parametrize("n", [40, 100_000])
@pytest.mark.parametrize("variant", ["basic", "best", "last", "additive"])
def test_products_meet_only_rows_that_share_a_column(variant, n):
    table = Table(variant, n)
    for u, i, v in FACTS:
        table.put(u, i, v)
    for row in range(40):
        others, dots, common = table.products(row)
        own = table.rows.get(row, {})
        expected = {o: (sum(own[c] * r[c] for c in own.keys() & r.keys()), len(own.keys() & r.keys())) for o, r in table.rows.items() if o != row and own.keys() & r.keys()}
        assert others.tolist() == sorted(expected) and [expected[o][1] for o in others.tolist()] == common.tolist()
        assert dots == pytest.approx([expected[o][0] for o in others.tolist()])
        assert [table.product(row, o) for o in others.tolist()] == dots.tolist()  # to the last bit
        assert not (table.sums.any() or table.met.any() or table.counts.any())  # ready for the next call
    assert table.product(0, 39) is None or table.rows[0].keys() & table.rows[39].keys()


def test_items_that_are_not_asked_need_no_similarity(monkeypatch):
    asked, whole = (Spec("ib", "ib", {"k": 3}).build(40, 12, 1), Spec("ib", "ib", {"k": 3, "item_k": 12}).build(40, 12, 1))
    for u, i, v in FACTS:
        asked.update(u, i, v)
        whole.update(u, i, v)
    expected = [whole.scores(u, np.arange(12)) for u in range(40)]
    monkeypatch.setattr(Table, "products", None)
    assert all(np.array_equal(asked.scores(u, np.arange(12)), e, equal_nan=True) for u, e in enumerate(expected))
