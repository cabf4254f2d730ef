import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloop.functions import scores as S
from feedloop.plans import loops
from feedloop.policies import jobs, registry
from feedloop.policies.factors import coordinate_als, implicit_als, weighted_error
from feedloop.policies.loop import Available, LimitedPool, Ratings, RoundRobin, end_after, replay, revealed, run
from feedloop.policies.neighbours import Cosine
from feedloop.policies.registry import POLICIES, Spec, expand
from feedloop.streaming.replay import replay_stream, windowed_rates


def _data(n_users=12, n_items=9, seed=0):
    rng = np.random.default_rng(seed)
    u = np.repeat(np.arange(n_users), 5)
    i = np.concatenate([rng.choice(n_items, 5, replace=False) for _ in range(n_users)])
    return Ratings(u, i, (rng.random(len(u)) < 0.5).astype(float), n_users, n_items)


@pytest.mark.parametrize("name", sorted(POLICIES))
def test_runs(name):
    spec = Spec(name, name, {"k": 3} if "pmf" in name or name == "mf" else {})
    a, b = (list(run(spec.build(12, 9, 3), _data(), 3, 60)) for _ in range(2))
    assert [x[:4] for x in a] == [x[:4] for x in b]  # a run is a function of its seed
    assert len({(x[2], x[3]) for x in a}) == len(a) == 60  # no pair twice
    values = _data().at
    assert all(v == values[u, i] if (u, i) in values else math.isnan(v) for _, _, u, i, v in a)
    ranked = list(run(spec.build(12, 9, 3), _data(), 3, 8, cutoff=4))
    assert {x[0] for x in ranked} == set(range(1, 9)) and max(x[1] for x in ranked) == 4
    empty = spec.build(12, 9, 3)
    assert empty.pick(0, np.array([], int)) == -1 and empty.pick(0, np.array([4])) == 4 and empty.rank(0, np.array([], int), 3) == []


def test_whole_run_ends_and_finds_everything():
    data = _data()
    out = list(run(Spec("r", "random", {}).build(12, 9, 1), data, 1, 0))
    assert len(out) == 12 * 9 and sum(v >= 0.5 for *_, v in out) == data.relevant()


def test_scores_of_a_folded_log_equal_the_expressions(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), float(r)) for i, r in zip(rng.integers(0, 6, 200), rng.random(200), strict=True)]
    per = spark.createDataFrame(rows, "i int, y double").groupBy("i").agg(F.count("*").alias("n"), F.avg("y").alias("m"), (F.var_pop("y") * F.count("*")).alias("q"))
    per = per.withColumn("t", F.lit(200.0)).select("i", "m", S.ucb1(F.col("m"), F.col("n"), F.col("t")).alias("a"), S.ucb1_tuned(F.col("m"), F.col("q"), F.col("n"), F.col("t")).alias("b"))
    expected = {r["i"]: r for r in per.collect()}
    for name, column in (("average", "m"), ("itembandit-ucb1", "a"), ("itembandit-ucb1tuned", "b")):
        policy = Spec("p", name, {}).build(1, 6, 0)
        for i, r in rows:
            policy.update(0, i, r)
        for i, s in enumerate(policy.scores(0, np.arange(6))):
            assert s == pytest.approx(expected[i][column])


def test_similarity_kept_up_to_date_equals_recomputed():
    rng = np.random.default_rng(4)
    sim, rows, columns = Cosine(7), np.zeros((7, 5)), {}
    for _ in range(120):
        u, i, v = int(rng.integers(7)), int(rng.integers(5)), float(rng.integers(1, 6))
        old, rows[u, i] = rows[u, i], v
        columns.setdefault(i, {})[u] = v
        sim.change(u, columns[i], old, v)
    others, got = sim.of(3)
    expected = rows @ rows[3] / np.maximum(np.linalg.norm(rows, axis=1) * np.linalg.norm(rows[3]), 1e-12)
    assert np.allclose(got, expected[others])


def test_factorisers_fit():
    data = _data(30, 20, 1)
    x = data.users, data.items, np.ones(len(data.users))
    for fit in (implicit_als, coordinate_als):
        p, q = fit(x, (30, 20), 6, np.random.default_rng(0), alpha=20.0, reg=0.1, rounds=8)
        assert weighted_error(x, p, q, 20.0) < 0.1


def test_missing_values():
    p = Spec("a", "average", {"ignore_unknown": True}).build(1, 2, 0)
    p.update(0, 0, float("nan"))
    assert p.n[0] == 0
    p = Spec("a", "average", {"ignore_unknown": False}).build(1, 2, 0)
    p.update(0, 0, float("nan"))
    assert p.n[0] == 1 and p.mean[0] == 0


def test_selection_and_ends():
    data = _data()
    users = RoundRobin(np.arange(3), np.random.default_rng(0))
    assert [users.next() for _ in range(4)] == [0, 1, 2, 0]
    users.drop(0)
    assert [users.next() for _ in range(3)] == [1, 2, 1]
    pool = LimitedPool(data, np.random.default_rng(0), size=4)
    user, items = pool.next()
    assert len(set(items.tolist())) == 4 and any(data.at.get((user, i), 0) >= 0.5 for i in items.tolist())
    own = Available(_data(9, 9), np.random.default_rng(0), contact=True)
    assert all(u not in items for u, items in (own.next() for _ in range(20)))
    assert end_after(0, 9)(10**9, 9) is False and end_after(5, 9)(5, 0) and end_after(0.5, 9)(1, 5) and not end_after(0.5, 9)(1, 4)
    both = revealed(data, 0, 1, "undirected")
    assert [x[:2] for x in both] == [(0, 1), (1, 0)]


def test_resume_goes_on_where_a_run_stopped():
    spec, data = Spec("u", "itembandit-ucb1", {}), _data()
    first = list(run(spec.build(12, 9, 5, "id"), data, 5, 20))
    again = list(run(spec.build(12, 9, 5, "id"), data, 5, 30, stored=[(x[2], x[3]) for x in first]))
    assert [x[:4] for x in again[:20]] == [x[:4] for x in first] and len({x[2:4] for x in again}) == 30


def test_known_view():
    data = _data()
    data.known = np.arange(len(data.users)) % 2 == 0
    assert len(data.view("known").users) + len(data.view("unknown").users) == len(data.users)


def test_grid(tmp_path):
    entries = [
        {"name": "itembandit", "params": [{"ignoreUnknown": "false", "bandit": {"name": "epsilon", "params": [{"epsilon": "0.1", "updateFunc": {"function": "nonStationary", "alpha": 0.2}}, {"epsilon": 0.2}]}}]},
        {"name": "mf", "params": [{"variant": "best", "k": "3", "factorizer": {"name": "plsa", "params": [{"numIter": 2}]}}]},
        {"name": "inter-pmf", "params": [{"k": 2, "lambdaP": 0.1, "lambdaQ": 0.1, "stdev": 1, "variant": {"name": "ucb", "params": [{"alpha": 1}, {"alpha": 2}]}}]},
    ]
    path = tmp_path / "grid.json"
    path.write_text(json.dumps([entries, entries[:1]]))
    assert [len(x) for x in registry.load(str(path))] == [5, 2]
    assert {s.policy for s in expand(entries)} == {"itembandit-epsilon", "mf", "inter-pmf-ucb"}
    for s in expand(entries):
        assert len(list(run(s.build(12, 9, 0), _data(), 0, 15))) == 15
    with pytest.raises(ValueError, match="no such policy"):
        expand([{"name": "nothing"}])


def test_simulate_job(spark):
    d = _data()
    df = spark.createDataFrame([(int(u), int(i), float(v)) for u, i, v in zip(d.users, d.items, d.values, strict=True)], "u int, i int, r double")
    specs = [Spec("random", "random", {}), Spec("ucb", "itembandit-ucb1", {})]
    out = jobs.simulate(df, specs, [1, 2], 25, 12, 9)
    assert {(r["run"], r["seed"]): r["n"] for r in out.groupBy("run", "seed").agg(F.count("*").alias("n")).collect()} == {(s.name, k): 25 for s in specs for k in (1, 2)}
    assert out.where("isnan(value)").count() == 0


def _log(n=400):
    rng = np.random.default_rng(8)
    out = []
    for k in range(n):
        cands = sorted(rng.choice(6, 3, replace=False).tolist())
        out.append((k, int(rng.integers(5)), int(rng.choice(cands)), float(rng.random() < 0.3), cands))
    return out


SCHEMA = "seq bigint, u int, i int, reward double, cands array<int>"
SPECS = [Spec("avg", "average", {}), Spec("ucb", "itembandit-ucb1", {})]


def test_replay_matches_a_plain_fold(spark):
    rows = _log()
    got = {(r["run"], r["seq"]) for r in jobs.replay_log(spark.createDataFrame(rows, SCHEMA).repartition(3), SPECS, [0], 5, 6, ties="id").collect()}
    expected = {(s.name, x[0]) for s in SPECS for x in replay(s.build(5, 6, 0, "id"), ((*r[:4], np.array(r[4])) for r in rows))}
    assert got == expected and expected


def test_replay_with_a_random_pool():
    rows = [(*r[:4], np.array(r[4])) for r in _log()]
    out = [list(replay(SPECS[0].build(5, 6, 0), iter(rows), extra=2, rng=np.random.default_rng(1))) for _ in range(2)]
    assert out[0] == out[1] and 0 < len(out[0]) < len(rows)


def test_streaming_replay_equals_batch(spark, tmp_path):
    rows = _log()
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = replay_stream(stream, SPECS, [0], 5, 6, ties="id").writeStream.format("memory").queryName("matches").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    got = {(r["run"], r["seq"]) for r in spark.table("matches").collect()}
    batch = {(r["run"], r["seq"]) for r in jobs.replay_log(spark.createDataFrame(rows, SCHEMA), SPECS, [0], 5, 6, ties="id").collect()}
    assert got == batch


def test_windowed_rates(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", True), ("2024-01-01 00:50:00", False), ("2024-01-01 05:00:00", True)]
    spark.createDataFrame(rows, "t string, hit boolean").select(F.col("t").cast("timestamp").alias("t"), "hit").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, hit boolean").parquet(str(tmp_path / "in"))
    query = windowed_rates(stream, "t", "hit").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r["shown"], r["clicked"], r["rate"]) for r in spark.table("rates").collect()} == {(2, 1, 0.5), (1, 1, 1.0)}


@pytest.mark.parametrize("name", ["replay_ucb1", "sim_eps"])
def test_loop_queries(spark, name):
    assert loops.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
