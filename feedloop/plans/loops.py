"""Queries of the feedback loop: policies that replay the interaction log, and closed loops over the ratings.

The ``..._fold`` queries run policies without chance (ties by the lower item, users in turn), so that recursive SQL gives the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloop.operators import logs as L
from feedloop.operators import preferences as P
from feedloop.operators.prefix import dense_codes
from feedloop.policies.jobs import replay_log, simulate
from feedloop.policies.registry import Spec
from feedloop.session import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEEDS = [1, 2]
THRESHOLD = 4.0
#: End of a closed loop: iterations of each run.
ITERATIONS = 2000
#: Iterations of the loops that SQL folds row by row.
FOLDED = 400
#: End of a loop that goes on until no user has an item left.
WHOLE = 0

REPLAYED = {
    "replay_random": ("random", {}), "replay_popularity": ("popularity", {}), "replay_average": ("average", {}), "replay_epsilon": ("itembandit-epsilon", {"epsilon": 0.1}),
    "replay_epsilont": ("itembandit-epsilont", {}), "replay_ucb1": ("itembandit-ucb1", {}), "replay_ucb1tuned": ("itembandit-ucb1tuned", {}),
    "replay_thompson": ("itembandit-thompson", {}), "replay_delaythompson": ("itembandit-delaythompson", {}), "replay_mlepop": ("itembandit-mlepop", {}),
    "replay_mleavg": ("itembandit-mleavg", {}), "replay_inf_theory": ("inf-theory", {}), "replay_userknn": ("ub", {}), "replay_itemknn": ("ib", {}),
}
LOOPED = {
    "sim_random": ("random", {}), "sim_eps": ("itembandit-epsilon", {}), "sim_ucb": ("itembandit-ucb1", {}), "sim_thompson": ("itembandit-thompson", {}),
    "sim_userknn": ("ub", {}), "sim_userknn_bandit": ("ub-bandit", {}), "sim_itemknn": ("ib", {}), "sim_itemknn_bandit": ("ib-bandit", {}),
    "sim_collab_greedy": ("collab-greedy", {}),
    "sim_mf": ("mf", {"k": 4, "rounds": 3, "limit": 400}), "sim_mf_fast": ("mf", {"k": 4, "factorizer": "fastimf", "rounds": 3, "limit": 400}),
    "sim_mf_plsa": ("mf", {"k": 4, "factorizer": "plsa", "limit": 400}), "sim_pmf_epsilon": ("inter-pmf-epsilon", {"k": 4, "refresh": 100}),
    "sim_pmf_ucb": ("inter-pmf-ucb", {"k": 4}), "sim_pmf_glmucb": ("inter-pmf-glmucb", {"k": 4}), "sim_pmf_thompson": ("inter-pmf-thompson", {"k": 4}),
    "sim_pts": ("pts", {}), "sim_bayesian_pts": ("bayesian-pts", {}), "sim_ictr": ("ictr", {}), "sim_ictr_ucb": ("ictr-ucb", {}),
}
#: Loops that hold a graph of all users against all: over the small event table, see README.
CLUSTERED = {"sim_club": ("club", {}, FOLDED), "sim_club_erdos": ("club-erdos", {}, FOLDED), "sim_cofiba": ("cofiba", {}, WHOLE)}

# --- SQL of policies without chance -----------------------------------------------------------------------------------
#: name -> (policy, arguments, score of an item in SQL). n, s, q, p: its values, their sum, their squares' sum, and how many are relevant; t: all values.
_MEAN, _FIRST = "CASE WHEN n > 0 THEN s / n ELSE 0 END", "'Infinity'::DOUBLE"
FOLDS = {
    "popularity": ("popularity", {}, "p"),
    "average": ("average", {}, _MEAN),
    "ucb1": ("itembandit-ucb1", {}, f"CASE WHEN n > 0 THEN s / n + sqrt(2 * ln(t + 1) / n) ELSE {_FIRST} END"),
    "ucb1tuned": (
        "itembandit-ucb1tuned", {},
        f"CASE WHEN n > 0 THEN s / n + sqrt(ln(t + 1) / n * least(0.25, q - s * s / n - (s / n) * (s / n) + sqrt(2 * ln(t + 1) / n))) ELSE {_FIRST} END",
    ),
    "greedy": ("itembandit-epsilon", {"epsilon": 0.0}, _MEAN),
    "count": ("itembandit-epsilon", {"epsilon": 0.0, "step": "count"}, "s"),
}
_STATE = ("n", "s", "q", "p")


def _at(score: str) -> str:
    """The score of item c in the state a."""
    for name in _STATE:
        score = re.sub(rf"(?<![\w.'])\b{name}\b(?![\w('])", f"a.{name}[c]", score)
    return re.sub(r"(?<![\w.'])\bt\b(?![\w('])", "a.t", score)


def _first(items: str, score: str) -> str:
    """The item of the highest score, the lower one of equal scores."""
    return f"list_sort(list_transform({items}, lambda c: struct_pack(a := -round({_at(score)}, 9), c := c)))[1].c"


def _put(name: str, when: str, code: str, value: str) -> str:
    return f"{name} := CASE WHEN {when} THEN a.{name}[:{code} - 1] || [{value}] || a.{name}[{code} + 1:] ELSE a.{name} END"


_EMPTY = "t := 0.0::DOUBLE, n := []::DOUBLE[], s := []::DOUBLE[], q := []::DOUBLE[], p := []::DOUBLE[]"
_ZEROS = "t := 0.0::DOUBLE, n := zeros, s := zeros, q := zeros, p := zeros"


def _replay_sql(score: str) -> str:
    """The log folded row by row: a row counts if its item is the first of its candidates."""
    hit = f"({_first('r.cands', score)} = r.code)"
    row = f"struct_pack(seq := seq, code := code, ok := (reward IS NOT NULL AND NOT isnan(reward))::INT::DOUBLE, y := CASE WHEN reward IS NULL OR isnan(reward) THEN 0.0::DOUBLE ELSE reward END, cands := cands, {_EMPTY}, hits := []::BIGINT[])"
    step = ", ".join(
        [f"t := CASE WHEN {hit} THEN a.t + r.ok ELSE a.t END", _put("n", hit, "r.code", "a.n[r.code] + r.ok"), _put("s", hit, "r.code", "a.s[r.code] + r.y"),
         _put("q", hit, "r.code", "a.q[r.code] + r.y * r.y"), _put("p", hit, "r.code", "a.p[r.code] + (r.y >= 0.5)::INT")]
    )
    return f"""WITH g AS (SELECT seq, uidx AS u, iidx AS i, reward, list_distinct(list_filter(list_append(coalesce(cands, []), iidx), lambda c: c IS NOT NULL)) AS cands
  FROM replay_log WHERE iidx IS NOT NULL AND uidx IS NOT NULL),
d AS (SELECT c, row_number() OVER (ORDER BY c) AS code FROM (SELECT DISTINCT unnest(cands) AS c FROM g)),
w AS (SELECT seq, list(code ORDER BY code) AS cands FROM (SELECT seq, unnest(cands) AS c FROM g) JOIN d USING (c) GROUP BY seq),
o AS (SELECT seq, code, reward, w.cands AS cands FROM g JOIN w USING (seq) JOIN d ON d.c = g.i),
z AS (SELECT list_transform(range(count(*)), lambda x: 0.0::DOUBLE) AS zeros FROM d),
f AS (SELECT list_reduce((SELECT list({row} ORDER BY seq) FROM o),
  lambda a, r: struct_pack(seq := r.seq, code := r.code, ok := r.ok, y := r.y, cands := r.cands, {step}, hits := CASE WHEN {hit} THEN list_append(a.hits, r.seq) ELSE a.hits END),
  (SELECT struct_pack(seq := 0::BIGINT, code := 0::BIGINT, ok := 0.0::DOUBLE, y := 0.0::DOUBLE, cands := []::BIGINT[], {_ZEROS}, hits := []::BIGINT[]) FROM z)) AS st)
SELECT g.seq, g.u, g.i, g.reward FROM (SELECT unnest(st.hits) AS seq FROM f) h JOIN g USING (seq)"""


def _sim_sql(score: str, rounds: int) -> str:
    """A closed loop over users in turn: the first item the user hasn't had; its value is learnt if there is one."""
    own = "list_transform(list_filter(a.hits, lambda h: h.k % r.users = r.k % r.users), lambda h: h.c)"
    c = _first(f"list_filter(r.every, lambda c: NOT list_contains({own}, c))", score)
    seen = "list_contains(r.rated, a.c)"
    value = "list_contains(r.liked, a.c)::INT::DOUBLE"
    # Two steps for each round: choosing an item, then learning its value.
    step = ", ".join(
        [f"t := CASE WHEN r.learns AND {seen} THEN a.t + 1 ELSE a.t END", *(_put(x, f"r.learns AND {seen}", "a.c", f"a.{x}[a.c] + {y}") for x, y in (("n", "1"), ("s", value), ("q", value), ("p", value)))]
    )
    row = f"struct_pack(k := k, learns := learns, users := users, every := CASE WHEN learns THEN [] ELSE every END, rated := rated, liked := liked, c := 0::BIGINT, {_EMPTY}, hits := []::STRUCT(k BIGINT, c BIGINT, v DOUBLE)[])"
    return f"""WITH x AS (SELECT uidx AS u, iidx AS i, max(value) AS r FROM ratings
  WHERE uidx IS NOT NULL AND iidx IS NOT NULL AND NOT isnan(value) AND value BETWEEN 0.5 AND 5 GROUP BY 1, 2),
d AS (SELECT i, row_number() OVER (ORDER BY i) AS code FROM (SELECT DISTINCT i FROM x)),
p AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS place, list(code) AS rated, coalesce(list(code) FILTER (r >= {THRESHOLD}), []) AS liked FROM x JOIN d USING (i) GROUP BY u),
c AS (SELECT (SELECT count(*) FROM p) AS users, (SELECT list(code ORDER BY code) FROM d) AS every),
o AS (SELECT k, learns, users, every, rated, liked FROM (SELECT unnest(range({rounds})) AS k) CROSS JOIN (SELECT unnest([FALSE, TRUE]) AS learns) CROSS JOIN c JOIN p ON place = k % users),
z AS (SELECT list_transform(every, lambda x: 0.0::DOUBLE) AS zeros FROM c),
f AS (SELECT list_reduce((SELECT list({row} ORDER BY k, learns) FROM o),
  lambda a, r: struct_pack(k := r.k, learns := r.learns, users := r.users, every := r.every, rated := r.rated, liked := r.liked, c := CASE WHEN r.learns THEN a.c ELSE {c} END, {step},
    hits := CASE WHEN r.learns THEN list_append(a.hits, struct_pack(k := r.k, c := a.c, v := CASE WHEN {seen} THEN {value} END)) ELSE a.hits END),
  (SELECT struct_pack(k := 0::BIGINT, learns := FALSE, users := 0::BIGINT, every := []::BIGINT[], rated := []::BIGINT[], liked := []::BIGINT[], c := 0::BIGINT, {_ZEROS}, hits := []::STRUCT(k BIGINT, c BIGINT, v DOUBLE)[]) FROM z)) AS st)
SELECT (h.k + 1)::INTEGER AS iter, p.u, d.i, h.v AS value FROM (SELECT unnest(st.hits) AS h FROM f) JOIN d ON d.code = h.c JOIN p ON p.place = h.k % (SELECT users FROM c)"""


# --- Queries ----------------------------------------------------------------------------------------------------------
def _coded_log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """(log over dense codes, users, items, how many of each); codes follow the ids' order."""
    log = L.with_candidates(table(spark, d, "replay_log")).where("u IS NOT NULL")
    users = cut(dense_codes(log.select("u"), "u").select("u", F.col("code").cast("int").alias("cu")))
    items = cut(dense_codes(log.select(F.explode("cands").alias("i")), "i").select("i", F.col("code").cast("int").alias("ci")))
    wide = log.select("seq", F.explode("cands").alias("i")).join(items, "i").groupBy("seq").agg(F.sort_array(F.collect_list("ci")).alias("cands"))
    coded = log.drop("cands").join(wide, "seq").join(users, "u").join(items, "i").select("seq", F.col("cu").alias("u"), F.col("ci").alias("i"), "reward", "cands")
    return coded, users, items, users.count(), items.count()


def _decoded(runs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    named = runs.withColumnsRenamed({"u": "cu", "i": "ci"}).join(items, "ci").join(users, "cu")
    return named.select(*runs.columns)


def _replay(policy: str, args: dict, seeds: list[int], ties: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        log, users, items, n_users, n_items = _coded_log(spark, d)
        return _decoded(replay_log(log, [Spec(policy, policy, args)], seeds, n_users, n_items, ties), users, items)

    return query


def _rated(spark: SparkSession, d: str) -> DataFrame:
    best = P.merge(P.interactions(table(spark, d, "ratings")), "best")
    return best.select("u", "i", P.binarise(F.col("r"), THRESHOLD, False).alias("r"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """A pair's value: whether any of its events was worth more than 100."""
    events = table(spark, d, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL AND NOT isnan(value)")
    return events.groupBy(F.col("user_id").alias("u"), F.col("event_type").alias("i")).agg(F.max((F.col("value") > 100).cast("double")).alias("r"))


def _loop(policy: str, args: dict, seeds: list[int], ties: str, limit: int, source: Callable = _rated, **how) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        best = cut(source(spark, d))
        users = cut(dense_codes(best.select("u"), "u").select("u", F.col("code").cast("int").alias("cu")))
        items = cut(dense_codes(best.select("i"), "i").select("i", F.col("code").cast("int").alias("ci")))
        coded = best.join(users, "u").join(items, "i").select(F.col("cu").alias("u"), F.col("ci").alias("i"), "r")
        return _decoded(simulate(coded, [Spec(policy, policy, args)], seeds, limit, users.count(), items.count(), ties=ties, **how), users, items)

    return query


for _name, (_policy, _args) in REPLAYED.items():
    QUERIES[_name] = _replay(_policy, _args, SEEDS, "random")
for _name, (_policy, _args) in LOOPED.items():
    QUERIES[_name] = _loop(_policy, _args, SEEDS, "random", ITERATIONS)
for _name, (_policy, _args, _limit) in CLUSTERED.items():
    QUERIES[_name] = _loop(_policy, _args, SEEDS, "random", _limit, _events)


def _fold_query(name: str, policy: str, args: dict, score: str) -> None:
    replayed, looped = _replay(policy, args, [1], "id"), _loop(policy, args, [1], "id", FOLDED, users="round-robin")
    QUERIES[f"replay_{name}_fold"] = lambda spark, d: replayed(spark, d).select("seq", "u", "i", "reward")
    QUERIES[f"sim_{name}_fold"] = lambda spark, d: looped(spark, d).select("iter", "u", "i", "value")
    SQL[f"replay_{name}_fold"] = _replay_sql(score)
    SQL[f"sim_{name}_fold"] = _sim_sql(score, FOLDED)


for _name, (_policy, _args, _score) in FOLDS.items():
    _fold_query(_name, _policy, _args, _score)
