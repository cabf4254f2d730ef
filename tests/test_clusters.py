import tracemalloc

import numpy as np
import pytest

from feedloop.plans import loops
from feedloop.policies.clusters import COFIBA, start_graph
from feedloop.policies.loop import RandomUsers
from feedloop.policies.registry import Spec


def _parts(flags, members):
    """Components by brute force."""
    left, out = set(members), []
    for m in sorted(members):
        if m in left:
            own, open_ = {m}, [m]
            while open_:
                new = {w for w in np.flatnonzero(flags[open_.pop()]).tolist() if w in left} - own
                own |= new
                open_ += new
            left -= own
            out.append(sorted(own))
    return out


@pytest.mark.parametrize("kind", ["complete", "erdos"])
def test_components_after_removals(kind):
    for seed in range(15):
        rng = np.random.default_rng(seed)
        n = 30
        g = start_graph(n, kind, rng)
        flags = np.array([g.row(v) for v in range(n)])
        assert (flags == flags.T).all() and not flags.diagonal().any() and (kind == "erdos" or flags.sum() == n * (n - 1))
        for k in range(40):
            v = int(rng.integers(n))
            others = np.flatnonzero(g.row(v) & (rng.random(n) < (1.0 if k % 2 else 0.7)))
            g.remove(v, others)
            flags[v, others] = flags[others, v] = False
            assert (np.array([g.row(w) for w in range(n)]) == flags).all()
            members = rng.permutation(np.flatnonzero(rng.random(n) < 0.8))
            assert [p.tolist() for p in g.split(members)] == _parts(flags, members.tolist())


def test_share_of_drawn_edges():
    n = 3000
    degree = np.array([start_graph(n, "erdos", np.random.default_rng(1)).row(v).sum() for v in range(0, n, 200)])
    p = 3 * np.log(n) / n
    g = start_graph(n, "erdos", np.random.default_rng(2))
    assert abs(len(g.others) / (n * (n - 1)) - p) < 0.01 * p and 10 < degree.min() and degree.max() < 50 and (g.ends != g.others).all()
    assert [len(start_graph(k, "erdos", np.random.default_rng(3)).others) for k in (1, 2, 4)] == [0, 2, 12]
    assert abs(np.mean([len(start_graph(40, "erdos", np.random.default_rng(s)).others) for s in range(200)]) / (40 * 39) - 3 * np.log(40) / 40) < 0.01


@pytest.mark.parametrize("name", ["club", "club-erdos", "cofiba"])
def test_a_hundred_thousand_users(name):
    """Users x users would be ten billion cells."""
    policy = Spec(name, name, {}).build(100_000, 5, 3)
    for k in range(12):
        item = policy.pick(k, np.arange(5))
        policy.update(k, item, float(k % 2))


@pytest.mark.parametrize("name", ["club", "club-erdos"])
def test_memory_of_ninety_thousand_users(name):
    """The users of sf0.1's events 60 times: flags of users x users would be 8,100 MB."""
    tracemalloc.start()
    try:
        policy = Spec(name, name, {}).build(90_000, 5, 3)
        for k in range(40):
            policy.update(k, policy.pick(k, np.arange(5)), float(k % 2))
        assert tracemalloc.get_traced_memory()[1] < 400e6
    finally:
        tracemalloc.stop()


def test_cofiba_goes_on_until_no_user_has_an_item_left(spark, tmp_path):
    """600 pairs of users and event types, each once in each run, with its value; some have no events, some no value."""
    values = {(u, f"type{k}"): None if (u + k) % 13 == 0 else float((u * 7 + k) % 3 > 0) for u in range(100, 220) for k in range(5) if (u * k) % 11 != 10}
    rows = [(u, i, y) for (u, i), r in values.items() for y in ((None,) if r is None else (3.0, 100.0 + r))]
    spark.createDataFrame([*rows, (None, "type0", 1.0), (5, None, 1.0), (7, "type0", float("nan"))], "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = loops.QUERIES["sim_cofiba"](spark, str(tmp_path)).collect()
    assert len(values) < 600 and len(got) == 1200
    for seed in loops.SEEDS:
        mine = [r for r in got if r["seed"] == seed]
        assert sorted((r["u"], r["i"]) for r in mine) == [(u, f"type{k}") for u in range(100, 220) for k in range(5)]
        assert sorted(r["iter"] for r in mine) == list(range(1, 601))
        assert all(r["value"] == values.get((r["u"], r["i"])) for r in mine)


@pytest.mark.parametrize("graph", ["erdos", "complete"])
def test_sums_kept_by_cofiba_equal_sums_made_anew(graph):
    splits = 0
    for seed in range(8):
        rng = np.random.default_rng(seed)
        policy = COFIBA(40, 8, np.random.default_rng(seed), alpha2=0.1, user_graph=graph, item_graph="complete")
        for _ in range(120):
            user, items = int(rng.integers(40)), np.sort(rng.choice(8, int(rng.integers(1, 9)), replace=False))
            for item, score in zip(items.tolist(), policy.scores(user, items).tolist(), strict=True):
                labels = policy.user_cluster[int(policy.item_cluster[item])]
                group = labels == labels[user]
                m = policy.m[group, item].sum() + 1
                assert score == pytest.approx(policy.b[group, item].sum() / m + np.sqrt(np.log(policy.t + 1) / m), abs=1e-6)
            policy.update(user, policy.pick(user, items), float(rng.integers(-8, 8)) / 4)
        splits += policy.clusters - 1 + sum(len(set(x.tolist())) - 1 for x in policy.user_cluster.values())
    assert splits > 50


def test_users_dropped_in_any_order():
    rng = np.random.default_rng(5)
    chooser, left = RandomUsers(np.arange(0, 90, 3), rng), list(range(0, 90, 3))
    for user in rng.permutation(left).tolist():
        chooser.drop(user)
        left.remove(user)
        assert chooser.left == left
    mixed = RandomUsers(np.array([5, 1, 9, 3]), rng)
    mixed.drop(1)
    assert mixed.left == [5, 9, 3]
