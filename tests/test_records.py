import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from feedloop.operators.key_chunks import chunked_states, heavy_keys, key_means
from feedloop.operators.strict_load import edges, rejects

GOOD = [
    "1\t2\t0.5\t3", "1\t2\t\t3", '"1"\t2\t0.5\t3', '1\t2\t""\t3', "007\t2\t1e3\t0", "1\t2\t1E+3\t3\r", "1\t1\t2.5e-3\t2147483647",
    "9223372036854775807\t2\t5\t1",
]
BAD = {
    None: "line is null", "": "line is empty", "\r": "line is empty", "1\t2\t3": "column count 3, not 4", "1\t2\t3\t4\t5": "column count 5, not 4",
    "1\t2\t3\t4\t": "column count 5, not 4", "\t1\t2\t3\t4": "column count 5, not 4", '"1\t2\t3\t4': "broken quoting", '1"\t2\t3\t4': "broken quoting",
    "x\t2\t3\t4": "nodeA is not digits", " 1\t2\t3\t4": "nodeA is not digits", "-1\t2\t3\t4": "nodeA is not digits", "١\t2\t3\t4": "nodeA is not digits",
    "9223372036854775808\t2\t3\t4": "nodeA out of range", "1\t\t3\t4": "nodeB is not digits", "1\t2\t.5\t4": "weight is not a number",
    "1\t2\t1.\t4": "weight is not a number", "1\t2\tNaN\t4": "weight is not a number", "1\t2\t1e999\t4": "weight is not finite",
    "1\t2\t3\t": "types is not digits", "1\t2\t3\t2147483648": "types out of range", "1\t2\t3\t4\r\r": "types is not digits",
    '1\t2\t3\t"4""5"': "types is not digits", "1\t2\t3\t4\n": "types is not digits",
}


def test_strict_load(spark):
    lines = [(k, line, "clash") for k, line in enumerate([*GOOD, *BAD])]
    df = spark.createDataFrame(lines, "line_id bigint, line string, weight string")
    assert sorted(r[0] for r in edges(df).collect()) == list(range(len(GOOD)))
    assert {r["line"]: r["reason"] for r in rejects(df).collect()} == BAD
    one = {r["line_id"]: r for r in edges(df).collect()}
    assert (one[0]["node_a"], one[0]["weight"], one[0]["types"]) == (1, 0.5, 3)
    assert one[1]["weight"] is None and one[3]["weight"] is None


def test_offsets_null_and_repeated(spark):
    df = spark.createDataFrame([(None, GOOD[0]), (None, "x"), (7, GOOD[1]), (7, "y"), (7, GOOD[1])], "line_id bigint, line string")
    assert edges(df).count() == 3
    assert sorted(r["line"] for r in rejects(df).collect()) == ["x", "y"]


def test_very_long_lines(spark):
    long = ['"' + "a" * 300_000 + '"\t2\t3\t4', '"' + 'a""' * 100_000 + '"\t2\t3\t4', "x" * 1_000_000, "\t" * 200_000, '1\t2\t3\t"' + "4" * 100_000, "1" * 100_000 + "\t2\t3\t4"]
    df = spark.createDataFrame(list(enumerate(long)), "line_id bigint, line string")
    reasons = [r["reason"] for r in rejects(df).orderBy("line_id").collect()]
    assert reasons == ["nodeA is not digits"] * 2 + ["column count 1, not 4", "column count 200001, not 4", "broken quoting", "nodeA out of range"]


def test_no_lines(spark):
    df = spark.createDataFrame([], "line_id bigint, line string")
    assert edges(df).count() == rejects(df).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='12"\t.eE+- \r\nx', max_size=14), max_size=60))
def test_every_line_is_loaded_or_rejected(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "line_id bigint, line string")
    assert edges(df).count() + rejects(df).count() == len(lines)


def _rows(n=3000, seed=3):
    rnd = random.Random(seed)
    key = lambda: None if rnd.random() < 0.02 else (5 if rnd.random() < 0.4 else rnd.randint(0, 80))
    value = lambda: rnd.choice([None, float("nan"), 1.0, 2.5, 4.0])
    return [(key(), value(), "x") for _ in range(n)]


def test_key_means_against_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k int, v double, _key string").repartition(5)
    expected = {}
    for k, v, _ in rows:
        if k is not None:
            n, good = expected.setdefault(k, [0, []])
            expected[k][0] += 1
            if v is not None and v == v:
                good.append(v)
    got = {r["k"]: r for r in key_means(df, "k", "v", chunks=17).collect()}
    assert set(got) == set(expected)
    for k, (n, good) in expected.items():
        assert (got[k]["n_rows"], got[k]["n_values"]) == (n, len(good))
        assert got[k]["mean_value"] == pytest.approx(sum(good) / len(good)) if good else got[k]["mean_value"] is None


def test_chunks_are_even(spark):
    df = spark.createDataFrame([(k, v) for k, v, _ in _rows() if k is not None], "k int, v double").repartition(5)
    sizes = [r[1] for r in chunked_states(df, "k", "v", chunks=10).groupBy("_chunk").sum("_rows").collect()]
    assert sum(sizes) == df.count()
    assert max(sizes) <= df.count() / 10 * 1.5  # 40 per cent of the rows have one key


def test_key_means_edges(spark):
    empty = spark.createDataFrame([], "k int, v double")
    assert key_means(empty, "k", "v").count() == 0
    nulls = spark.createDataFrame([(None, 1.0), (3, None), (3, float("nan"))], "k int, v double")
    assert [tuple(r) for r in key_means(nulls, "k", "v").collect()] == [(3, 2, 0, None)]


def test_heavy_keys(spark):
    df = spark.createDataFrame([(k, v) for k, v, _ in _rows()], "k int, v double")
    assert [tuple(r) for r in heavy_keys(df, ["k"], "v", 0.2).collect()] == [("k", 5)]
