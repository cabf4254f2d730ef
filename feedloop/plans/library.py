"""Queries of the recommendation operators over the rating, log, index and edge tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloop.functions import sampling
from feedloop.functions import scores as S
from feedloop.operators import curves as C
from feedloop.operators import graph as G
from feedloop.operators import logs as L
from feedloop.operators import neighbours as K
from feedloop.operators import preferences as P
from feedloop.operators import splits as D
from feedloop.operators.prefix import dense_codes, sums_before
from feedloop.operators.strict_load import edges as typed_edges
from feedloop.plans.records import _P2
from feedloop.session import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
THRESHOLD, INTERVAL, RUNS, LAST_K = 4.0, 1000, 4, 1500
#: Users and items whose code is divisible by this are the stated queries of neighbourhood searches.
EVERY = 50

_X = """x AS (SELECT seq, uidx AS u, iidx AS i, value AS r, coalesce(known, FALSE) AS known FROM ratings
  WHERE uidx IS NOT NULL AND iidx IS NOT NULL AND NOT isnan(value) AND value BETWEEN 0.5 AND 5),
m AS (SELECT u, i, max(r) AS r FROM x GROUP BY u, i)"""
_LOG = """l AS (SELECT seq, uidx AS u, iidx AS i, reward, list_distinct(list_filter(list_append(coalesce(cands, []), iidx), lambda c: c IS NOT NULL)) AS cands
  FROM replay_log WHERE iidx IS NOT NULL)"""
_RUNS = f"""{_LOG},
n AS (SELECT seq % {RUNS} AS run, seq, u, i, reward, row_number() OVER (PARTITION BY seq % {RUNS} ORDER BY seq) AS iter FROM l),
pt AS (SELECT run, max(iter) AS point FROM n GROUP BY run, ceil(iter / {INTERVAL}.0))"""
_G = _P2.strip() + """,
e AS (SELECT node_a AS src, node_b AS dst, min_by(coalesce(weight, 1.0), line_id) AS weight, min_by(types, line_id) AS type
  FROM g WHERE good AND node_a <> node_b GROUP BY 1, 2),
v AS (SELECT user_id AS v FROM user_index UNION SELECT src FROM e UNION SELECT dst FROM e)"""


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _x(spark: SparkSession, d: str) -> DataFrame:
    return P.interactions(table(spark, d, "ratings"))


def _m(spark: SparkSession, d: str) -> DataFrame:
    return P.merge(_x(spark, d), "best")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return L.with_candidates(table(spark, d, "replay_log"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return C.with_iterations(_log(spark, d).select(F.expr(f"seq % {RUNS}").alias("run"), "seq", "u", "i", "reward"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.from_edges(typed_edges(table(spark, d, "edge_lines")))


def _nodes(spark: SparkSession, d: str, e: DataFrame) -> DataFrame:
    return table(spark, d, "user_index").select(F.col("user_id").alias("v")).unionByName(G.vertices(e)).where("v IS NOT NULL").distinct()


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- Merge policies, views, counts ------------------------------------------------------------------------------------
for _name, _policy, _agg in (("merge_first", "basic", "min_by(r, seq)"), ("merge_last", "last", "max_by(r, seq)"), ("merge_best", "best", "max(r)"), ("merge_additive", "additive", "sum(r)")):
    QUERIES[_name] = lambda spark, d, policy=_policy: P.merge(_x(spark, d), policy)
    SQL[_name] = f"WITH {_X} SELECT u, i, {_agg} AS r FROM x GROUP BY u, i"


@query(f"WITH {_X} SELECT m.u, m.i, m.r FROM m WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.known AND x.u = m.u AND x.i = m.i)")
def delete_known(spark, d):
    return P.delete(_m(spark, d), _x(spark, d).where("known").select("u", "i").distinct())


@query("SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS code FROM user_index WHERE user_id IS NOT NULL")
def dict_encode_users(spark, d):
    return dense_codes(table(spark, d, "user_index"), "user_id")


@query("SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS code FROM item_index WHERE item_id IS NOT NULL")
def dict_encode_items(spark, d):
    return dense_codes(table(spark, d, "item_index"), "item_id")


@query("SELECT r.seq, u.user_id, i.item_id, r.value FROM ratings r JOIN user_index u ON r.uidx = u.uidx JOIN item_index i ON r.iidx = i.iidx WHERE r.value IS NOT NULL AND NOT isnan(r.value)")
def decode_ratings(spark, d):
    users, items = table(spark, d, "user_index").select("uidx", "user_id"), table(spark, d, "item_index").select("iidx", "item_id")
    rows = table(spark, d, "ratings").where("value IS NOT NULL AND NOT isnan(value)").join(users, "uidx").join(items, "iidx")
    return rows.select("seq", "user_id", "item_id", "value")


@query(f"WITH {_X} SELECT u, i, CASE WHEN r >= {THRESHOLD} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r, r >= {THRESHOLD} AS relevant FROM m")
def rating_binarise(spark, d):
    m = _m(spark, d)
    return m.select("u", "i", P.binarise(F.col("r"), THRESHOLD, False).alias("r"), P.is_relevant(F.col("r"), THRESHOLD).alias("relevant"))


@query(f"WITH {_X} SELECT count(*) AS n_ratings, count(DISTINCT u) AS n_users, count(DISTINCT i) AS n_items, count(*) FILTER (r >= {THRESHOLD}) AS n_relevant, round(avg(r), 6) AS mean FROM m")
def dataset_stats(spark, d):
    stats = _m(spark, d).agg(
        F.count("*").alias("n_ratings"), F.countDistinct("u").alias("n_users"), F.countDistinct("i").alias("n_items"),
        F.count_if(F.col("r") >= THRESHOLD).alias("n_relevant"), F.avg("r").alias("mean"),
    )
    return _rounded(stats, "mean")


@query(f"WITH {_X} SELECT u, count(DISTINCT i) FILTER (known) AS known_items, count(DISTINCT i) FILTER (NOT known) AS unknown_items, count(DISTINCT i) AS items FROM x GROUP BY u")
def knowledge_stats(spark, d):
    # Two plain counts after one aggregation by pair; no Expand of the rows for several distinct counts.
    per = _x(spark, d).groupBy("u", "i").agg(F.max("known").alias("k"), F.min("known").alias("a"))
    return per.groupBy("u").agg(F.count_if("k").alias("known_items"), F.count_if(~F.col("a")).alias("unknown_items"), F.count("*").alias("items"))


for _use, _cond in (("known", "known"), ("unknown", "NOT known"), ("all", "TRUE")):
    QUERIES[f"view_{_use}"] = lambda spark, d, use=_use: P.merge(P.view(_x(spark, d), use), "last")
    SQL[f"view_{_use}"] = f"WITH {_X} SELECT u, i, max_by(r, seq) AS r FROM x WHERE {_cond} GROUP BY u, i"


@query(f"WITH {_X}, w AS (SELECT DISTINCT uidx AS u, iidx AS i FROM replay_log WHERE uidx IS NOT NULL AND iidx IS NOT NULL) SELECT m.u, m.i, m.r FROM m JOIN w ON m.u = w.u AND m.i = w.i")
def restrict_to_pairs(spark, d):
    pairs = _log(spark, d).where("u IS NOT NULL").select("u", "i")
    return P.restrict(_m(spark, d), pairs)


@query(f"WITH {_X}, w AS (SELECT DISTINCT uidx AS u, iidx AS i FROM replay_log WHERE uidx IS NOT NULL AND iidx IS NOT NULL) SELECT count(*) AS listed, count(*) FILTER (m.r >= {THRESHOLD}) AS relevant FROM m JOIN w ON m.u = w.u AND m.i = w.i")
def relevant_count(spark, d):
    pairs = _log(spark, d).where("u IS NOT NULL").select("u", "i")
    return P.restrict(_m(spark, d), pairs).agg(F.count("*").alias("listed"), F.count_if(F.col("r") >= THRESHOLD).alias("relevant"))


@query(f"WITH {_X}, s AS (SELECT u, count(DISTINCT i) AS n FROM x GROUP BY u) SELECT uidx AS u, (SELECT count(*) FROM item_index) - coalesce(n, 0) AS available FROM user_index LEFT JOIN s ON u = uidx")
def availability_counts(spark, d):
    users = table(spark, d, "user_index").select(F.col("uidx").alias("u"))
    return P.availability(_x(spark, d), users, table(spark, d, "item_index").count())


@query(f"WITH {_X}, {_LOG} SELECT l.seq, l.u, l.i, m.r FROM l LEFT JOIN m ON l.u = m.u AND l.i = m.i")
def reveal_left_join(spark, d):
    return P.reveal(_log(spark, d).select("seq", "u", "i"), _m(spark, d)).select("seq", "u", "i", "r")


@query(f"""WITH {_X}, a AS (SELECT u, i, max_by(r, seq) AS r FROM x WHERE known GROUP BY u, i), b AS (SELECT u, i, max_by(r, seq) AS r FROM x WHERE NOT known GROUP BY u, i)
SELECT coalesce(a.u, b.u) AS u, coalesce(a.i, b.i) AS i, coalesce(b.r, a.r) AS r FROM a FULL JOIN b ON a.u = b.u AND a.i = b.i""")
def merge_lists(spark, d):
    """Known and unknown values in one list; where a pair has both, the unknown one counts."""
    known, unknown = (P.merge(P.view(_x(spark, d), use), "last").withColumnRenamed("r", use) for use in ("known", "unknown"))
    return known.join(unknown, ["u", "i"], "full").select("u", "i", F.coalesce("unknown", "known").alias("r"))


@query(f"""WITH {_X}, a AS (SELECT u, i, max_by(r, seq) AS r FROM x WHERE known GROUP BY u, i), b AS (SELECT u, i, max_by(r, seq) AS r FROM x WHERE NOT known GROUP BY u, i)
SELECT a.u, a.i, a.r + b.r AS r FROM a JOIN b ON a.u = b.u AND a.i = b.i""")
def intersect_lists(spark, d):
    known, unknown = (P.merge(P.view(_x(spark, d), use), "last").withColumnRenamed("r", use) for use in ("known", "unknown"))
    return known.join(unknown, ["u", "i"]).select("u", "i", (F.col("known") + F.col("unknown")).alias("r"))


@query(f"""WITH {_X}, p AS (SELECT u, i, bool_or(known) AS a, bool_or(NOT known) AS b FROM x GROUP BY u, i)
SELECT u, count(*) FILTER (a AND b) AS common, count(*) AS merged, bool_or(a AND b) AS overlap FROM p GROUP BY u""")
def merge_intersect_sizes(spark, d):
    per = _x(spark, d).groupBy("u", "i").agg(F.max("known").alias("a"), F.max(~F.col("known")).alias("b"))
    both = F.col("a") & F.col("b")
    return per.groupBy("u").agg(F.count_if(both).alias("common"), F.count("*").alias("merged"), F.max(both).alias("overlap"))


@query(f"WITH {_LOG} SELECT seq, u, i, reward, list_sort(cands) AS cands FROM l")
def log_candidates(spark, d):
    return _log(spark, d).withColumn("cands", F.array_sort("cands"))


# --- Splits -----------------------------------------------------------------------------------------------------------
_SPLIT = f"""WITH {_X}, {_LOG}, c AS (SELECT count(*) AS n FROM l),
s AS (SELECT l.seq, l.u, l.i, row_number() OVER (ORDER BY l.seq) AS place FROM l),
p AS (SELECT s.*, CAST(ceil(place * 10 / n::DOUBLE) - 1 AS INTEGER) AS part, m.r, coalesce(m.r >= {THRESHOLD}, FALSE) AS relevant FROM s CROSS JOIN c LEFT JOIN m ON s.u = m.u AND s.i = m.i),
q AS (SELECT p.*, sum(relevant::INT) OVER (ORDER BY place) AS rel, sum(relevant::INT) OVER () AS all_rel FROM p)
"""


def _parts(spark, d):
    parts = D.uniform(_log(spark, d).select("seq", "u", "i"), "seq", 10)
    return P.reveal(parts, _m(spark, d)).withColumn("relevant", P.is_relevant(F.col("r"), THRESHOLD))


@query(_SPLIT + "SELECT part, min(place) AS first, max(place) AS last FROM p GROUP BY part")
def uniform_split(spark, d):
    return D.uniform(_log(spark, d).select("seq"), "seq", 10).groupBy("part").agg(F.min("place").alias("first"), F.max("place").alias("last"))


@query(_SPLIT + "SELECT c AS part, min(place) AS \"end\" FROM q CROSS JOIN (SELECT unnest(range(1, 11))::INTEGER AS c) WHERE rel * 10 >= all_rel * c GROUP BY c")
def relevant_split(spark, d):
    rows = P.reveal(_log(spark, d).select("seq", "u", "i"), _m(spark, d))
    return D.by_relevant(rows, "seq", P.is_relevant(F.col("r"), THRESHOLD), 10)


@query(_SPLIT + "SELECT place, u, i FROM p WHERE place <= floor(0.3 * (SELECT n FROM c))")
def percent_split(spark, d):
    return D.first_percent(_log(spark, d).select("seq", "u", "i"), "seq", 0.3).select("place", "u", "i")


@query(_SPLIT + "SELECT split, count(*) AS recs, count(r) AS ratings, count(*) FILTER (relevant) AS relevant FROM p JOIN (SELECT unnest(range(1, 11))::INTEGER AS split) ON part < split GROUP BY split")
def train_stats(spark, d):
    return D.training_statistics(_parts(spark, d), 10)


@query(_SPLIT + "SELECT u, i, r FROM p WHERE part < 3 AND r IS NOT NULL")
def warmup_ratings(spark, d):
    return D.warmup(_parts(spark, d).where("part < 3"), full=False).select("u", "i", "r")


@query(_SPLIT + f""", w AS (SELECT DISTINCT u, i FROM p WHERE part < 3), k AS (SELECT u, count(*) AS n FROM w WHERE u IS NOT NULL GROUP BY u)
SELECT uidx AS u, (SELECT count(*) FROM item_index) - coalesce(n, 0) AS available FROM user_index LEFT JOIN k ON u = uidx""")
def warmup_availability(spark, d):
    users = table(spark, d, "user_index").select(F.col("uidx").alias("u"))
    return P.availability(D.warmup(_parts(spark, d).where("part < 3"), full=True), users, table(spark, d, "item_index").count())


# --- Item scores ------------------------------------------------------------------------------------------------------
_ITEMS = f"""WITH {_X}, z AS (SELECT i, seq, r / 5 AS y FROM x), t AS (SELECT count(*)::DOUBLE AS t FROM z),
s AS (SELECT i, count(*) AS n, sum(y) AS s, avg(y) AS mean, var_pop(y) * count(*) AS sq FROM z GROUP BY i)
"""


def _items(spark, d):
    y = F.col("r") / 5
    per = _x(spark, d).groupBy("i").agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.avg(y).alias("mean"), (F.var_pop(y) * F.count("*")).alias("sq"))
    return per.crossJoin(F.broadcast(_x(spark, d).agg(F.count("*").cast("double").alias("t"))))


def _top(df: DataFrame, k: int = 50) -> DataFrame:
    return df.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "i").limit(k).select("i", "score")


def _top_sql(expr: str, frm: str = "s CROSS JOIN t", k: int = 50) -> str:
    return _ITEMS + f"SELECT i, round({expr}, 6) AS score FROM {frm} ORDER BY score DESC, i LIMIT {k}"


@query(_ITEMS + f"SELECT i, count(*) FILTER (y * 5 >= {THRESHOLD}) AS score FROM z GROUP BY i ORDER BY score DESC, i LIMIT 50")
def topk_popularity(spark, d):
    per = _x(spark, d).groupBy("i").agg(F.count_if(F.col("r") >= THRESHOLD).alias("score"))
    return per.orderBy(F.desc("score"), "i").limit(50)


@query(_top_sql("mean"))
def topk_average(spark, d):
    return _top(_items(spark, d).withColumn("score", F.col("mean")))


@query(_top_sql("mean + sqrt(2 * ln(t + 1) / n)"))
def topk_ucb1(spark, d):
    return _top(_items(spark, d).withColumn("score", S.ucb1(F.col("mean"), F.col("n"), F.col("t"))))


@query(_top_sql("mean + sqrt(ln(t + 1) / n * least(0.25, sq - mean * mean + sqrt(2 * ln(t + 1) / n)))"))
def topk_ucb1_tuned(spark, d):
    return _top(_items(spark, d).withColumn("score", S.ucb1_tuned(F.col("mean"), F.col("sq"), F.col("n"), F.col("t"))))


@query(_top_sql("(s + 1) / (n + 2)"))
def topk_beta_mean(spark, d):
    return _top(_items(spark, d).withColumn("score", S.beta_mean(F.col("s"), F.col("n"), 1.0, 1.0)))


@query()
def topk_thompson(spark, d):
    """Items by a sample of their success rate's posterior."""
    items = _items(spark, d)
    return _top(items.withColumn("score", sampling.beta(F.col("i"), F.col("s") + 1, F.col("n") - F.col("s") + 1, seed=7)))


@query(_ITEMS + "SELECT i, round(mean, 6) AS score, n FROM s")
def eps_stationary(spark, d):
    return _items(spark, d).select("i", F.round("mean", 6).alias("score"), "n")




@query(_ITEMS + """, o AS (SELECT i, y, row_number() OVER (PARTITION BY i ORDER BY seq DESC) - 1 AS age FROM z)
SELECT i, round(sum(0.1 * pow(0.9, age) * y), 6) AS score FROM o GROUP BY i""")
def eps_nonstationary(spark, d):
    """Moving value of every item's rewards in file order; an item's rows stay spread: each block is reduced to its
    part of the sum first, and the blocks' ages follow from how many rows come later."""
    x = _x(spark, d).select("i", "seq", (F.col("r") / 5).alias("y"), F.floor(F.col("seq") / (1 << 16)).alias("b"))
    inside = Window.partitionBy("i", "b").orderBy(F.desc("seq"))
    aged = x.withColumn("age", F.row_number().over(inside) - 1)
    per = aged.groupBy("i", "b").agg(F.sum(0.1 * F.pow(F.lit(0.9), F.col("age")) * F.col("y")).alias("v"), F.count("*").alias("n"))
    later = F.coalesce(F.sum("n").over(Window.partitionBy("i").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("later", later).groupBy("i").agg(F.round(F.sum(F.pow(F.lit(0.9), F.col("later")) * F.col("v")), 6).alias("score"))


@query(_ITEMS + "SELECT i, round(s, 6) AS score FROM s")
def eps_count(spark, d):
    return _items(spark, d).select("i", F.round("s", 6).alias("score"))


@query(_ITEMS + "SELECT i, round((s + 1) / (SELECT sum(s + 1) FROM s), 9) AS p FROM s")
def mle_pop_prob(spark, d):
    items = _items(spark, d).select("i", "s")
    total = F.broadcast(items.agg(F.sum(F.col("s") + 1).alias("all")))
    return items.crossJoin(total).select("i", F.round((F.col("s") + 1) / F.col("all"), 9).alias("p"))


@query(_ITEMS + f""", h AS (SELECT i, count(*) FILTER (y * 5 >= {THRESHOLD}) / count(*)::DOUBLE AS q FROM z GROUP BY i)
SELECT i, round(q / (SELECT sum(q) FROM h), 9) AS p FROM h""")
def mle_avg_prob(spark, d):
    rate = _x(spark, d).groupBy("i").agg((F.count_if(F.col("r") >= THRESHOLD) / F.count("*")).alias("q"))
    return rate.crossJoin(F.broadcast(rate.agg(F.sum("q").alias("all")))).select("i", F.round(F.col("q") / F.col("all"), 9).alias("p"))


@query(f"""WITH {_X}, c AS (SELECT u, count(*) AS den, count(*) FILTER (r >= {THRESHOLD}) AS num FROM m GROUP BY u)
SELECT i, round(sum(ln(den) - ln(num)), 6) AS score FROM m JOIN c ON m.u = c.u WHERE r >= {THRESHOLD} GROUP BY i""")
def inf_theory_scores(spark, d):
    m = _m(spark, d)
    users = m.groupBy("u").agg(F.count("*").alias("den"), F.count_if(F.col("r") >= THRESHOLD).alias("num"))
    rows = m.where(F.col("r") >= THRESHOLD).join(users, "u")
    return rows.groupBy("i").agg(F.round(F.sum(F.ln("den") - F.ln("num")), 6).alias("score"))


@query(f"""WITH {_X}, p AS (SELECT i, row_number() OVER (ORDER BY count(*) FILTER (r >= {THRESHOLD}) DESC, i) AS rank FROM m GROUP BY i),
q AS (SELECT uidx AS u FROM user_index WHERE uidx % {EVERY} = 0),
a AS (SELECT u, i, rank FROM q CROSS JOIN p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.u = q.u AND m.i = p.i))
SELECT u, i, row_number() OVER (PARTITION BY u ORDER BY rank) AS place FROM a QUALIFY place <= 10""")
def topk_unseen(spark, d):
    m = _m(spark, d)
    votes = m.groupBy("i").agg(F.count_if(F.col("r") >= THRESHOLD).alias("n")).select((-F.col("n")).alias("o"), "i").withColumn("_n", F.lit(1))
    ranked = sums_before(votes, ["o", "i"], "_n").select("i", (F.col("_before") + 1).alias("rank"))
    users = table(spark, d, "user_index").where(f"uidx % {EVERY} = 0").select(F.col("uidx").alias("u"))
    seen = m.join(users, "u", "left_semi")
    return P.unseen_best(seen, users, ranked, 10)


# --- Neighbourhoods ---------------------------------------------------------------------------------------------------
def _pairs_sql(k: str, j: str, state: str, extra: str = "") -> str:
    return f"""WITH {_X}, st AS ({state}), p AS (SELECT a.k AS a, b.k AS b, sum(a.r * b.r) AS dot, count(*) AS common FROM st a JOIN st b ON a.j = b.j AND a.k <> b.k
  WHERE a.k % {EVERY} = 0 GROUP BY 1, 2), nm AS (SELECT k, sqrt(sum(r * r)) AS norm, count(*) AS n FROM st GROUP BY k){extra}
"""


_US = "SELECT u AS k, i AS j, r FROM m"
_NEAR = ", nb AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS place FROM sm QUALIFY place <= 10)\n"
_COS = ", sm AS (SELECT p.a, p.b, dot / (x1.norm * x2.norm) AS sim FROM p JOIN nm x1 ON x1.k = p.a JOIN nm x2 ON x2.k = p.b)"


def _users(spark, d):
    """The merged state by user."""
    return _m(spark, d).select(F.col("u").alias("k"), "i", "r")


def _queries(state: DataFrame) -> DataFrame:
    return state.where(F.col("k") % EVERY == 0)


@query(_pairs_sql("u", "i", _US) + _COS + _NEAR + "SELECT a, b, round(sim, 6) AS sim, place FROM nb")
def cosine_topk(spark, d):
    st = _users(spark, d)
    return _rounded(K.nearest_to(_queries(st), st, "cosine", 10), "sim")


@query(_pairs_sql("u", "i", _US) + ", sm AS (SELECT a, b, dot / common AS sim FROM p WHERE dot > 0)" + _NEAR + "SELECT a, b, round(sim, 6) AS sim, place FROM nb")
def restricted_cosine_topk(spark, d):
    st = _users(spark, d)
    return _rounded(K.nearest_to(_queries(st), st, "restricted", 10), "sim")


@query(_pairs_sql("u", "i", f"SELECT u AS k, i AS j, r FROM m WHERE r >= {THRESHOLD}") + ", sm AS (SELECT a, b, (common + 1) / (n + 2)::DOUBLE AS sim FROM p JOIN nm ON nm.k = b)" + _NEAR + "SELECT a, b, round(sim, 6) AS sim, place FROM nb")
def beta_exact_topk(spark, d):
    st = _users(spark, d).where(F.col("r") >= THRESHOLD)
    return _rounded(K.nearest_to(_queries(st), st, "beta", 10, 1.0, 2.0), "sim")


@query(_pairs_sql("u", "i", _US) + _COS + _NEAR + """, sc AS (SELECT nb.a AS u, st.j AS i, sum(sim * r) AS score FROM nb JOIN st ON st.k = nb.b
  WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.u = nb.a AND m.i = st.j) GROUP BY 1, 2)
SELECT u, i, round(score, 6) AS score, row_number() OVER (PARTITION BY u ORDER BY round(score, 9) DESC, i) AS place FROM sc QUALIFY place <= 10""")
def userknn_scores(spark, d):
    st = _users(spark, d)
    own = _queries(st)
    near = K.nearest_to(own, st, "cosine", 10)
    return _rounded(K.by_users(near, st, own.select(F.col("k").alias("u"), "i"), 10), "score")


@query(_pairs_sql("i", "u", "SELECT i AS k, u AS j, r FROM m").replace(f"a.k % {EVERY} = 0", f"a.k IN (SELECT i FROM m WHERE u % {EVERY} = 0)") + _COS + _NEAR + f""", ow AS (SELECT u, i, r FROM m WHERE u % {EVERY} = 0),
sc AS (SELECT ow.u, nb.b AS i, sum(sim * r) AS score FROM ow JOIN nb ON ow.i = nb.a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.u = ow.u AND m.i = nb.b) GROUP BY 1, 2)
SELECT u, i, round(score, 6) AS score, row_number() OVER (PARTITION BY u ORDER BY round(score, 9) DESC, i) AS place FROM sc QUALIFY place <= 10""")
def itemknn_scores(spark, d):
    """What is near to the items of the query users; every item that a user rated votes."""
    m = cut(_m(spark, d))
    near = K.nearest_of_all(m.select(F.col("i").alias("k"), F.col("u").alias("i"), "r"), 10)
    own = m.where(F.col("u") % EVERY == 0)
    return _rounded(K.by_items(near, own, own.select("u", "i"), 10), "score")


# --- Metric curves ----------------------------------------------------------------------------------------------------
_REVEALED = f"""WITH {_X}, {_RUNS},
f AS (SELECT n.run, n.iter, n.u, n.i, coalesce(m.r >= {THRESHOLD}, FALSE) AS hit, row_number() OVER (PARTITION BY run, n.u, n.i ORDER BY seq) = 1 AS fresh FROM n LEFT JOIN m ON n.u = m.u AND n.i = m.i),
ni AS (SELECT count(*) AS n_items FROM item_index), nr AS (SELECT greatest(count(*) FILTER (r >= {THRESHOLD}), 1) AS n_rel FROM m),
h AS (SELECT pt.run, pt.point, count(*) FILTER (hit AND fresh) AS hits FROM pt JOIN f ON f.run = pt.run AND f.iter <= pt.point GROUP BY 1, 2),
c AS (SELECT pt.run, pt.point, w.iidx AS i, count(n.i) AS freq FROM pt CROSS JOIN item_index w LEFT JOIN n ON n.run = pt.run AND n.iter <= pt.point AND n.i = w.iidx GROUP BY 1, 2, 3),
o AS (SELECT c.*, row_number() OVER (PARTITION BY run, point ORDER BY freq) AS k FROM c),
gi AS (SELECT run, point, sum((2 * k - n_items - 1) * freq) / ((max(n_items) - 1) * sum(freq))::DOUBLE AS gini FROM o CROSS JOIN ni GROUP BY run, point)
"""


@query(_REVEALED + "SELECT h.run, h.point, round(hits / n_rel::DOUBLE, 9) AS recall, round(1 - gini, 6) AS evenness FROM h JOIN gi ON gi.run = h.run AND gi.point = h.point CROSS JOIN nr")
def cum_recall_gini_points(spark, d):
    m, runs = _m(spark, d), _runs(spark, d)
    relevant = m.where(F.col("r") >= THRESHOLD)
    n_rel = F.broadcast(relevant.agg(F.greatest(F.count("*"), F.lit(1)).alias("_rel")))
    # A pair counts once for a run, at its first row.
    fresh = C.first_only(runs).join(relevant.select("u", "i"), ["u", "i"], "left_semi").select("run", "seq", F.lit(1).alias("hit"))
    marked = runs.join(fresh, ["run", "seq"], "left")
    recall = C.cumulative(marked, {"hits": F.col("hit")}, INTERVAL).crossJoin(n_rel).select("run", "point", F.round(F.col("hits") / F.col("_rel"), 9).alias("recall"))
    n_items = table(spark, d, "item_index").count()
    even = C.gini(C.frequencies(runs, INTERVAL), F.lit(n_items), ["run", "point"]).select("run", "point", F.round(1 - F.col("gini"), 6).alias("evenness"))
    return recall.join(even, ["run", "point"])


for _use, _cond in (("known", "known"), ("unknown", "NOT known")):

    def _recall(spark, d, use=_use):
        shown = P.merge(P.view(_x(spark, d), use), "best").where(F.col("r") >= THRESHOLD)
        total = F.broadcast(shown.agg(F.greatest(F.count("*"), F.lit(1)).alias("_rel")))
        runs = _runs(spark, d)
        fresh = C.first_only(runs).join(shown.select("u", "i"), ["u", "i"], "left_semi").select("run", "seq", F.lit(1).alias("hit"))
        hits = C.cumulative(runs.join(fresh, ["run", "seq"], "left"), {"hits": F.col("hit")}, INTERVAL)
        return hits.crossJoin(total).select("run", "point", F.round(F.col("hits") / F.col("_rel"), 9).alias("recall"))

    QUERIES[f"{_use}_recall"] = _recall
    SQL[f"{_use}_recall"] = f"""WITH {_X}, {_RUNS}, k AS (SELECT u, i, max(r) AS r FROM x WHERE {_cond} GROUP BY u, i), w AS (SELECT u, i FROM k WHERE r >= {THRESHOLD}),
f AS (SELECT n.run, n.u, n.i, min(iter) AS iter FROM n JOIN w ON n.u = w.u AND n.i = w.i GROUP BY 1, 2, 3)
SELECT pt.run, pt.point, round(count(f.i) / (SELECT greatest(count(*), 1) FROM w)::DOUBLE, 9) AS recall FROM pt LEFT JOIN f ON f.run = pt.run AND f.iter <= pt.point GROUP BY 1, 2"""


@query(f"WITH {_RUNS} SELECT pt.run, pt.point, round(count(*) FILTER (reward > 0) / count(*)::DOUBLE, 9) AS ctr, count(*) AS counter FROM pt JOIN n ON n.run = pt.run AND n.iter <= pt.point GROUP BY 1, 2")
def ctr_curve(spark, d):
    sums = {"clicks": (F.col("reward") > 0).cast("int"), "counter": F.lit(1)}
    return C.cumulative(_runs(spark, d), sums, INTERVAL).select("run", "point", F.round(F.col("clicks") / F.col("counter"), 9).alias("ctr"), "counter")


@query(f"WITH {_RUNS} SELECT pt.run, pt.point, count(*) AS counter, count(DISTINCT n.i) AS items FROM pt JOIN n ON n.run = pt.run AND n.iter <= pt.point GROUP BY 1, 2")
def counter_curve(spark, d):
    return C.frequencies(_runs(spark, d), INTERVAL).groupBy("run", "point").agg(F.sum(F.col("freq") * F.col("m")).alias("counter"), F.sum("m").alias("items"))


_EPC = f"""WITH {_RUNS}, k AS (SELECT pt.run, pt.point, n.i, count(*) AS freq FROM pt JOIN n ON n.run = pt.run AND n.iter <= pt.point {{}} GROUP BY 1, 2, 3)
"""
_LAST = f"AND n.iter > pt.point - {LAST_K}"
_EPC_VALUE = "SELECT run, point, round(1 - sum(freq * freq) / ((SELECT count(*) FROM user_index) * sum(freq))::DOUBLE, 9) AS epc FROM k GROUP BY 1, 2"


@query(_EPC.format("") + _EPC_VALUE)
def epc_curve(spark, d):
    users = table(spark, d, "user_index").count()
    return C.epc(C.frequencies(_runs(spark, d), INTERVAL), F.lit(users)).withColumn("epc", F.round("epc", 9))


@query(_EPC.format(_LAST) + _EPC_VALUE)
def epc_at_k(spark, d):
    users = table(spark, d, "user_index").count()
    return C.epc(C.last_frequencies(_runs(spark, d), INTERVAL, LAST_K), F.lit(users)).withColumn("epc", F.round("epc", 9))


@query(_EPC.format(_LAST) + """, ni AS (SELECT count(*) AS n_items FROM item_index), q AS (SELECT DISTINCT run, point FROM k),
c AS (SELECT q.run, q.point, iidx AS i, coalesce(freq, 0) AS freq FROM q CROSS JOIN item_index LEFT JOIN k ON k.run = q.run AND k.point = q.point AND k.i = iidx),
o AS (SELECT c.*, row_number() OVER (PARTITION BY run, point ORDER BY freq) AS r FROM c)
SELECT run, point, round(1 - sum((2 * r - n_items - 1) * freq) / ((max(n_items) - 1) * sum(freq))::DOUBLE, 6) AS evenness FROM o CROSS JOIN ni GROUP BY run, point""")
def gini_at_k(spark, d):
    n = table(spark, d, "item_index").count()
    g = C.gini(C.last_frequencies(_runs(spark, d), INTERVAL, LAST_K), F.lit(n), ["run", "point"])
    return g.select("run", "point", F.round(1 - F.col("gini"), 6).alias("evenness"))


def _vectors(spark, d):
    """``(i, dim, x)``: unit vectors of the items."""
    vectors = table(spark, d, "embeddings")
    n = vectors.count()
    e = F.transform("embedding", lambda x: x.cast("double"))
    length = F.sqrt(S.dot(e, e))
    dims = vectors.select("vec_id", F.posexplode(F.transform(e, lambda x: x / length)).alias("dim", "x"))
    items = table(spark, d, "item_index").select(F.col("iidx").alias("i"), F.expr(f"CAST(iidx % {n} AS BIGINT)").alias("vec_id"))
    return items.join(dims, "vec_id").select("i", "dim", "x")


@query(f"""WITH {_RUNS}, v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))) AS len FROM embeddings),
nv AS (SELECT count(*) AS nv FROM embeddings), w AS (SELECT DISTINCT run, u, i FROM n),
t AS (SELECT run, u, v.e, v.len FROM w CROSS JOIN nv JOIN v ON v.vec_id = w.i % nv),
s AS (SELECT run, u, unnest(e) / len AS y, unnest(range(1, len(e) + 1)) AS dim FROM t), k AS (SELECT run, u, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(*) > 1),
z AS (SELECT run, u, dim, sum(y) AS y FROM s GROUP BY 1, 2, 3), g AS (SELECT run, u, sum(y * y) AS s FROM z GROUP BY 1, 2)
SELECT g.run, round(avg(1 - (s - n) / (n * (n - 1))::DOUBLE), 6) AS ild FROM g JOIN k ON g.run = k.run AND g.u = k.u GROUP BY 1""")
def ild_curve(spark, d):
    """Mean distance within users' lists at the end of each run; an item's features are the vector at its code modulo
    the number of vectors."""
    return _rounded(C.intra_list_distance(_runs(spark, d).where("u IS NOT NULL"), _vectors(spark, d)), "ild")


@query(f"""WITH {_RUNS}, v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))) AS len FROM embeddings),
nv AS (SELECT count(*) AS nv FROM embeddings), w AS (SELECT DISTINCT pt.run, pt.point, u, i FROM pt JOIN n ON n.run = pt.run AND n.iter <= pt.point WHERE u IS NOT NULL),
t AS (SELECT run, point, u, v.e, v.len FROM w CROSS JOIN nv JOIN v ON v.vec_id = w.i % nv),
s AS (SELECT run, point, u, unnest(e) / len AS y, unnest(range(1, len(e) + 1)) AS dim FROM t), k AS (SELECT run, point, u, count(*) AS n FROM t GROUP BY 1, 2, 3 HAVING count(*) > 1),
z AS (SELECT run, point, u, dim, sum(y) AS y FROM s GROUP BY 1, 2, 3, 4), g AS (SELECT run, point, u, sum(y * y) AS s FROM z GROUP BY 1, 2, 3),
q AS (SELECT g.run, g.point, avg(1 - (s - n) / (n * (n - 1))::DOUBLE) AS ild FROM g JOIN k ON g.run = k.run AND g.point = k.point AND g.u = k.u GROUP BY 1, 2)
SELECT pt.run, pt.point, round(q.ild, 6) AS ild FROM pt LEFT JOIN q ON q.run = pt.run AND q.point = pt.point""")
def ild_points(spark, d):
    """The same at every point of the runs."""
    runs = _runs(spark, d)
    at = C.points(runs, INTERVAL).select("run", "point")
    found = C.intra_list_distances(runs, _vectors(spark, d), INTERVAL)
    return at.join(_rounded(found, "ild"), ["run", "point"], "left")


@query(f"""WITH {_X}, {_RUNS}, k AS (SELECT seq, unnest(cands) AS c FROM l),
p AS (SELECT k.seq, avg(CASE WHEN m.r >= {THRESHOLD} THEN 1.0 ELSE 0.0 END) AS p FROM k JOIN l ON l.seq = k.seq LEFT JOIN m ON m.u = l.u AND m.i = k.c GROUP BY 1)
SELECT pt.run, pt.point, round(avg(p.p), 9) AS precision FROM pt JOIN n ON n.run = pt.run AND n.iter <= pt.point JOIN p ON p.seq = n.seq GROUP BY 1, 2""")
def precision_curve(spark, d):
    """Running mean of the share of relevant items in each row's candidates."""
    log, runs = _log(spark, d), _runs(spark, d).select("run", "seq", "iter")
    wide = log.select("seq", "u", F.explode("cands").alias("i"))
    hit = P.reveal(wide, _m(spark, d)).groupBy("seq").agg(F.avg((F.coalesce(F.col("r"), F.lit(0.0)) >= THRESHOLD).cast("double")).alias("p"))
    mean = C.running_mean(runs.join(hit, "seq"), "p", INTERVAL)
    return mean.select("run", "point", F.round("mean", 9).alias("precision"))


@query(f"WITH {_RUNS} SELECT n.run, n.iter, n.u, n.i FROM n JOIN pt ON n.run = pt.run AND n.iter = pt.point")
def interval_samples(spark, d):
    runs = _runs(spark, d)
    return runs.join(C.points(runs, INTERVAL).select("run", F.col("point").alias("iter")), ["run", "iter"]).select("run", "iter", "u", "i")


@query(f"""WITH {_RUNS}, k AS (SELECT pt.run, pt.point, count(*) FILTER (reward > 0) / count(*)::DOUBLE AS ctr FROM pt JOIN n ON n.run = pt.run AND n.iter <= pt.point GROUP BY 1, 2),
z AS (SELECT run, max(point) AS point FROM k GROUP BY run)
SELECT k.run, round(ctr, 9) AS value, row_number() OVER (ORDER BY round(ctr, 9) DESC, k.run) AS place FROM k JOIN z ON k.run = z.run AND k.point = z.point""")
def rank_algorithms(spark, d):
    curve = ctr_curve(spark, d).groupBy("run").agg(F.max_by("ctr", "point").alias("value"))
    return curve.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), "run")).cast("bigint"))  # a row for each run


@query(f"""WITH {_RUNS}, k AS (SELECT pt.run, pt.point, count(*) FILTER (reward > 0) / count(*)::DOUBLE AS ctr FROM pt JOIN n ON n.run = pt.run AND n.iter <= pt.point GROUP BY 1, 2)
SELECT point, round(avg(ctr), 6) AS ctr, count(*) AS runs FROM k WHERE point % {INTERVAL} = 0 GROUP BY point""")
def summary_means(spark, d):
    curve = ctr_curve(spark, d).where(f"point % {INTERVAL} = 0")
    return curve.groupBy("point").agg(F.round(F.avg("ctr"), 6).alias("ctr"), F.count("*").alias("runs"))


@query(f"""WITH {_RUNS}, k AS (SELECT pt.run, pt.point, CAST(count(*) FILTER (reward > 0) AS VARCHAR) AS c FROM pt JOIN n ON n.run = pt.run AND n.iter <= pt.point GROUP BY 1, 2)
SELECT run, coalesce(max(c) FILTER (point = 1000), '-') AS p1000, coalesce(max(c) FILTER (point = 2000), '-') AS p2000, coalesce(max(c) FILTER (point = 5000), '-') AS p5000 FROM k GROUP BY run""")
def summary_pivot(spark, d):
    curve = C.cumulative(_runs(spark, d), {"clicks": (F.col("reward") > 0).cast("int")}, INTERVAL)
    wide = curve.groupBy("run").pivot("point", [1000, 2000, 5000]).agg(F.first("clicks").cast("string"))
    return wide.select("run", *(F.coalesce(F.col(str(p)), F.lit("-")).alias(f"p{p}") for p in (1000, 2000, 5000)))


# --- Logs -------------------------------------------------------------------------------------------------------------
@query(f"""WITH {_LOG}, s AS (SELECT i, round((count(*) FILTER (reward > 0) + 1) / (count(*) + 2)::DOUBLE, 9) AS score FROM l GROUP BY i),
w AS (SELECT seq, unnest(cands) AS c FROM l), k AS (SELECT seq, c, row_number() OVER (PARTITION BY seq ORDER BY coalesce(score, '-inf'::DOUBLE) DESC, c) AS place FROM w LEFT JOIN s ON s.i = w.c)
SELECT l.seq, l.u, l.i, l.reward FROM l JOIN k ON k.seq = l.seq AND k.place = 1 AND k.c = l.i""")
def replay_greedy_match(spark, d):
    log = _log(spark, d)
    rate = log.groupBy("i").agg(F.round((F.count_if(F.col("reward") > 0) + 1) / (F.count("*") + 2), 9).alias("score"))
    return L.replay_matches(log, rate).select("seq", "u", "i", "reward")


@query(f"WITH {_LOG} SELECT u, i, count(*) AS shown, count(*) FILTER (reward > 0) AS clicked, round(count(*) FILTER (reward > 0) / count(*)::DOUBLE, 6) AS rate FROM l GROUP BY u, i")
def pair_ctr(spark, d):
    return _rounded(L.pair_rates(_log(spark, d)), "rate")


for _name, _key in (("user_replay_stats", "u"), ("item_replay_stats", "i")):
    QUERIES[_name] = lambda spark, d, key=_key: L.replay_statistics(_log(spark, d), key)
    SQL[_name] = f"""WITH {_LOG}, p AS (SELECT u, i, count(*) AS n, count(*) FILTER (reward > 0) AS c FROM l GROUP BY u, i)
SELECT {_key}, sum(n)::BIGINT AS rows, sum(c)::BIGINT AS relevant, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (n > 1 AND c > 0) AS repeated_relevant FROM p WHERE {_key} IS NOT NULL GROUP BY {_key}"""


@query(f"WITH {_LOG} SELECT u, count(*) AS rows FROM l WHERE u IS NOT NULL GROUP BY u HAVING count(*) >= 5")
def min_activity_users(spark, d):
    return L.active_users(_log(spark, d), 5)


@query(f"WITH {_RUNS} SELECT run, seq, i, row_number() OVER (PARTITION BY run, i ORDER BY seq) - 1 AS before FROM n")
def popularity_before(spark, d):
    return C.popularity_before(_runs(spark, d)).select("run", "seq", "i", "before")


# --- Graphs -----------------------------------------------------------------------------------------------------------
@query(f"{_G} SELECT src, dst, weight, type FROM e")
def graph_edges(spark, d):
    return _edges(spark, d)


@query(f"""{_G}, k AS (SELECT src, dst, weight, type FROM e UNION ALL SELECT dst, src, weight, type FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.src = e.dst AND o.dst = e.src)),
a AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min_by(weight, (src > dst)::INT) AS weight, min_by(type, (src > dst)::INT) AS type FROM e GROUP BY 1, 2)
SELECT a AS src, b AS dst, weight, type FROM a UNION ALL SELECT b, a, weight, type FROM a""")
def graph_undirected(spark, d):
    return G.undirected(_edges(spark, d))


@query(f"""{_G}, o AS (SELECT src AS v, count(*) AS n FROM e GROUP BY 1), w AS (SELECT dst AS v, count(*) AS n FROM e GROUP BY 1)
SELECT v.v, coalesce(w.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(w.n, 0) + coalesce(o.n, 0) AS degree FROM v LEFT JOIN o ON o.v = v.v LEFT JOIN w ON w.v = v.v""")
def graph_degrees(spark, d):
    e = _edges(spark, d)
    return G.degrees(e, _nodes(spark, d, e))


@query(f"{_G} SELECT a.src, a.dst, a.weight AS adjacent, b.weight AS incident, (a.weight + b.weight) / 2 AS average FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src")
def graph_mutual(spark, d):
    return G.mutual(_edges(spark, d))


@query(f"{_G} SELECT v FROM v WHERE v IN (SELECT src FROM e) AND v NOT IN (SELECT dst FROM e)")
def graph_sources(spark, d):
    e = _edges(spark, d)
    return G.sources(e, _nodes(spark, d, e))


@query(f"{_G} SELECT v FROM v WHERE v IN (SELECT dst FROM e) AND v NOT IN (SELECT src FROM e)")
def graph_sinks(spark, d):
    e = _edges(spark, d)
    return G.sinks(e, _nodes(spark, d, e))


@query(f"{_G} SELECT v FROM v WHERE v NOT IN (SELECT dst FROM e) AND v NOT IN (SELECT src FROM e)")
def graph_isolated(spark, d):
    e = _edges(spark, d)
    return G.isolated(e, _nodes(spark, d, e))


@query(f"""{_G}, b AS (SELECT src AS v, dst AS neighbour, weight FROM e UNION ALL SELECT dst, src, weight FROM e)
SELECT v, neighbour, round(sum(weight), 6) AS weight FROM b GROUP BY 1, 2""")
def graph_neighbour_weights(spark, d):
    return _rounded(G.neighbour_weights(_edges(spark, d)), "weight")


@query(f"{_G} SELECT count(*) AS edges, count(*) FILTER (EXISTS (SELECT 1 FROM e o WHERE o.src = e.dst AND o.dst = e.src)) AS mutual, round(mutual / edges::DOUBLE, 6) AS reciprocity FROM e")
def graph_reciprocity(spark, d):
    return _rounded(G.reciprocity(_edges(spark, d)), "reciprocity")


@query(f"{_G} SELECT src, dst, weight, type FROM e WHERE type <> 1 UNION ALL SELECT DISTINCT e.dst, e.src, 0.5::DOUBLE, 9 FROM e WHERE type = 1 AND NOT EXISTS (SELECT 1 FROM e o WHERE o.src = e.dst AND o.dst = e.src AND o.type <> 1)")
def graph_changed(spark, d):
    """The graph without its edges of type 1, and with their reversals added where there is no edge."""
    e = cut(_edges(spark, d))
    gone = e.where("type = 1")
    new = gone.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.5).alias("weight"), F.lit(9).alias("type"))
    return G.add_edges(G.remove_edges(e, gone.select("src", "dst")), new)


@query(f"{_G}, o AS (SELECT src AS v, count(*) AS n FROM e GROUP BY 1) SELECT v.v, (SELECT count(*) FROM v) - 1 - coalesce(o.n, 0) AS missing FROM v LEFT JOIN o ON o.v = v.v")
def graph_complement_counts(spark, d):
    e = _edges(spark, d)
    return G.complement_counts(e, _nodes(spark, d, e))


@query(f"{_G}, h AS (SELECT src AS v FROM e GROUP BY src HAVING count(*) > 100) SELECT src, dst, weight, type FROM e WHERE src NOT IN (SELECT v FROM h) AND dst NOT IN (SELECT v FROM h)")
def graph_without_hubs(spark, d):
    e = _edges(spark, d)
    hubs = e.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("n")).where("n > 100").select("v")
    return G.without(e, hubs)


@query(f"""{_G}, r AS (SELECT *, CAST((row_number() OVER (PARTITION BY src ORDER BY dst) - 1) // 1000 AS INTEGER) AS part FROM e)
SELECT src, part, list(dst ORDER BY dst) AS neighbours, list(weight ORDER BY dst) AS weights FROM r GROUP BY src, part""")
def graph_adjacency(spark, d):
    return G.adjacency(_edges(spark, d))


@query(_G.replace("WITH", "WITH RECURSIVE", 1) + """,
b AS (SELECT src AS v, dst AS w FROM e UNION SELECT dst, src FROM e),
cc(v, component) USING KEY (v) AS (SELECT v, v FROM v UNION
  (SELECT b.w, min(x.component) FROM cc x JOIN b ON b.v = x.v JOIN recurring.cc y ON y.v = b.w WHERE x.component < y.component GROUP BY b.w))
SELECT v, component FROM cc""")
def connected_components(spark, d):
    e = _edges(spark, d)
    return G.components(e, _nodes(spark, d, e))


_CO = f"""WITH {_X}, p AS (SELECT u, i FROM m WHERE r >= {THRESHOLD}), n AS (SELECT u, count(*) AS n FROM p GROUP BY u),
k AS (SELECT a.u AS a, b.u AS b, count(*) AS common FROM p a JOIN p b ON a.i = b.i AND a.u <> b.u WHERE a.u % {EVERY} = 0 GROUP BY 1, 2 HAVING count(*) > 1),
w AS (SELECT a, b, common, x1.n + x2.n - 2 * common AS apart FROM k JOIN n x1 ON x1.u = a JOIN n x2 ON x2.u = b)
"""


def _liked(spark, d):
    """The relevant pairs, and those of the query users."""
    liked = _m(spark, d).where(F.col("r") >= THRESHOLD).select("u", "i")
    return liked, liked.where(F.col("u") % EVERY == 0)


@query(_CO + "SELECT a, b, common, round(1.0 / (apart + 1), 6) AS weight, round(sqrt(apart), 6) AS distance FROM w")
def corating_graph(spark, d):
    return G.co_rating_graph(*_liked(spark, d), places=6)


@query(_CO + ", c AS (SELECT unnest(range(2, 12)) AS least) SELECT least, count(*) AS edges, round(avg(sqrt(apart)), 6) AS mean_distance FROM w JOIN c ON common >= least GROUP BY least")
def corating_density(spark, d):
    """Edges and their mean distance as the least number of common items grows."""
    return _rounded(G.co_rating_density(*_liked(spark, d)), "mean_distance")
