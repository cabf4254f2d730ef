import gzip
import json

import pytest

from feedloop.__main__ import main
from feedloop.sources import text


def test_delimited(spark, tmp_path):
    (tmp_path / "r").write_text("1::10::4.5::99\n2::11::3\n")
    assert [tuple(r)[1:] for r in text.ratings(spark, str(tmp_path / "r")).orderBy("seq").collect()] == [(1, 10, 4.5), (2, 11, 3.0)]
    (tmp_path / "k").write_text("1::10::4::1\n1::11::2::0\n")
    assert [r["known"] for r in text.knowledge(spark, str(tmp_path / "k")).orderBy("seq").collect()] == [True, False]
    (tmp_path / "bad").write_text("x::10::4\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        text.ratings(spark, str(tmp_path / "bad")).collect()
    with gzip.open(tmp_path / "c.gz", "wt") as f:
        f.write("1\t2\n2\t1\n3\t3\n3\t1\n")
    assert text.contacts(spark, str(tmp_path / "c.gz"), directed=True).count() == 3
    assert text.contacts(spark, str(tmp_path / "c.gz"), directed=False).count() == 4


def test_log_index_seeds(spark, tmp_path):
    (tmp_path / "l").write_text("1\t5\t1.0\t4\t6\n2\t4\t0\n9\t9\n")
    rows = text.log(spark, str(tmp_path / "l")).orderBy("seq").collect()
    assert [(r["u"], r["i"], sorted(r["cands"])) for r in rows] == [(1, 5, [4, 5, 6]), (2, 4, [4])]
    assert [list(r["cands"]) for r in text.log(spark, str(tmp_path / "l"), single=True).orderBy("seq").collect()] == [[5], [4]]
    (tmp_path / "i").write_text("b\na\n")
    assert {r["id"]: r["code"] for r in text.index(spark, str(tmp_path / "i"), "string").collect()} == {"b": 0, "a": 1}
    (tmp_path / "s").write_text("3\n1\n")
    assert text.seeds(spark, str(tmp_path / "s")) == [3, 1]


def test_graph_files(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 0.5, 3), (2, 3, 1.5, 0), (4, 4, 1.0, 0)], "src bigint, dst bigint, weight double, type int")
    text.write_graph(edges, str(tmp_path / "g"), types=True)
    assert sorted(map(tuple, text.graph(spark, str(tmp_path / "g"), types=True).collect())) == [(1, 2, 0.5, 3), (2, 3, 1.5, 0)]
    assert text.graph(spark, str(tmp_path / "g"), loops=True, types=True).count() == 3
    nodes = spark.createDataFrame([(1,), (2,)], "v bigint")
    assert text.graph(spark, str(tmp_path / "g"), nodes=nodes, types=True).count() == 1


RUN = [(1, 0, 5, 10, 1), (1, 0, 6, 10, 2), (2, 1, 7, 20, 1)]


@pytest.mark.parametrize("compressed", [False, True])
def test_text_run(spark, tmp_path, compressed):
    df = spark.createDataFrame(RUN, "iter int, u int, i int, time bigint, rank int")
    text.write_run(df, str(tmp_path / "run"), compressed)
    got = text.read_run(spark, str(tmp_path / "run")).orderBy("iter", "rank").collect()
    assert [tuple(r)[:5] for r in got] == RUN and [r["score"] for r in got] == [1.0, 0.5, 1.0]


def test_torn_text_run(spark, tmp_path):
    (tmp_path / "t").write_text("numIter\tuidx\tiidx\ttime\n1\t0\t5\t10\n2\t1\t7")
    assert text.read_run(spark, str(tmp_path / "t")).count() == 1


def test_binary_run(spark, tmp_path):
    df = spark.createDataFrame(RUN, "iter int, u int, i int, time bigint, rank int")
    raw = b"".join(bytes(r["record"]) for r in text.binary_run(df).orderBy("iter").collect())
    (tmp_path / "b.bin").write_bytes(raw + b"\0\0\0")
    assert sorted(map(tuple, text.read_binary_run(spark, str(tmp_path / "b.bin")).collect())) == RUN


def test_news_log(spark, tmp_path):
    (tmp_path / "n").write_text("1317513291 id-5 1 |user 1 9 3 |id-5 1 2 |id-7 4\n1317513292 id-7 0 |user 1 |id-7 3\n")
    rows = text.news_log(spark, str(tmp_path / "n"), features=10).collect()
    assert len(rows) == 1 and rows[0]["user"] == "01000001" and list(rows[0]["cands"]) == ["id-5", "id-7"]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("data")
    (d / "r").write_text("".join(f"{u}::{i}::{(u * i) % 5 + 1}\n" for u in range(1, 9) for i in range(1, 8) if (u + i) % 3))
    (d / "c").write_text("".join(f"{u}\t{v}\n" for u in range(1, 9) for v in range(1, 9) if u < v and (u + v) % 3))
    (d / "grid.json").write_text(json.dumps([{"name": "random"}, {"name": "itembandit", "params": [{"bandit": {"name": "ucb1"}}]}]))
    (d / "lists.json").write_text(json.dumps([[{"name": "random"}], [{"name": "popularity"}]]))
    (d / "warm").write_text("numIter\tuidx\tiidx\ttime\n" + "".join(f"{k + 1}\t{k % 8}\t{k % 7}\t1\n" for k in range(30)))
    (d / "log").write_text("".join(f"{k % 4}\t{k % 3}\t{k % 2}\t0\t1\t2\n" for k in range(200)))
    (d / "users").write_text("0\n1\n2\n3\n")
    (d / "items").write_text("0\n1\n2\n")
    return d


@pytest.mark.parametrize(
    "args",
    [
        "rec --data {d}/r --algorithms {d}/grid.json --threshold 3 --end 20 --interval 10 --seeds 1 2",
        "valid --data {d}/r --algorithms {d}/grid.json --threshold 3 --end 0.5",
        "rec --type contact --data {d}/c --algorithms {d}/grid.json --end 20 --interval 10",
        "warmup-rec --data {d}/r --algorithms {d}/grid.json --threshold 3 --end 5 --warmup {d}/warm --parts 2",
        "warmup-valid --data {d}/r --algorithms {d}/grid.json --threshold 3 --end 5 --warmup {d}/warm --parts 3 --ratio 0.5",
        "train-stats --data {d}/r --threshold 3 --warmup {d}/warm --parts 3",
        "summarize --data {d}/r --threshold 3 --runs {d}/warm --interval 10 --points 10 20 99",
        "dataset --data {d}/r --threshold 3",
        "dataset-analysis --data {d}/r --threshold 3 --limit 2",
        "rec --type stream --data {d}/log --users {d}/users --items {d}/items --algorithms {d}/grid.json --interval 20",
        "rec --type stream --data {d}/log --users {d}/users --items {d}/items --algorithms {d}/grid.json --interval 20 --selection limited --pool 1 --warmup {d}/warm",
        "rec --data {d}/r --algorithms {d}/grid.json --threshold 3 --end 20 --interval 10 --selection limited --pool 3 --user-choice round-robin",
        "warmup-rec --data {d}/r --algorithms {d}/lists.json --threshold 3 --end 5 --warmup {d}/warm --parts 2",
    ],
)
def test_programs(spark, files, args):
    out = main(args.format(d=files).split(), spark)
    assert out.count() > 0


def test_no_rankings_in_replay(spark):
    with pytest.raises(SystemExit):
        main("rec --type stream --cutoff 5".split(), spark)


def test_lines_follow_the_order_of_files(spark, tmp_path):
    """Files of unequal size are packed into tasks by size; their lines still come in the order of names."""
    expected = []
    for name, n in (("a", 10), ("b", 1990), ("c", 1), ("d", 500), ("e", 0), ("f", 30)):
        own = [f"{name}{k}" for k in range(n)]
        (tmp_path / f"{name}.txt").write_text("".join(x + "\n" for x in own))
        expected += own
    rows = text.lines(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r["value"] for r in rows] == expected and len({r["seq"] for r in rows}) == len(rows)


def test_lines_of_one_file_in_several_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{k}\n" for k in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = text.lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5
        assert [int(r["value"]) for r in rows.orderBy("seq").collect()] == list(range(20_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_runs_are_written_resumed_and_summarised(spark, files, tmp_path):
    base = f"rec --data {files}/r --algorithms {files}/grid.json --threshold 3 --interval 10 --seeds 1 2 "
    main([*base.split(), "--end", "20", "--out", str(tmp_path / "a")], spark)
    first = text.read_runs(spark, str(tmp_path / "a" / "runs"))
    pairs = lambda df: {(r["run"], r["seed"], r["iter"]): (r["u"], r["i"]) for r in df.collect()}
    assert {r["run"] for r in first.collect()} == {"random", "itembandit-ucb1"} and first.count() == 2 * 2 * 20
    main([*base.split(), "--end", "30", "--resume", str(tmp_path / "a" / "runs"), "--out", str(tmp_path / "b")], spark)
    more = pairs(text.read_runs(spark, str(tmp_path / "b" / "runs")))
    assert len(more) == 2 * 2 * 30 and all(more[k] == v for k, v in pairs(first).items())
    one = str(tmp_path / "b" / "runs" / "run=random" / "seed=1")
    out = main(f"summarize --data {files}/r --threshold 3 --runs {one} --interval 10 --points 10 30 99".split(), spark)
    rows = {r["metric"]: r for r in out.collect()}
    assert set(rows) == {"recall", "evenness", "epc", "time"} and all(r["30"] != "-" and r["99"] == "-" for r in rows.values())


def test_each_split_has_its_own_policies(spark, files):
    out = main(f"warmup-rec --data {files}/r --algorithms {files}/lists.json --threshold 3 --end 5 --warmup {files}/warm --parts 2".split(), spark)
    assert {(r["split"], r["run"]) for r in out.select("split", "run").distinct().collect()} == {(1, "random"), (2, "popularity")}
