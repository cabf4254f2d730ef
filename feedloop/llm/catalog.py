"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloop.llm.bpe import encode
from feedloop.llm.cooccur import associations
from feedloop.llm.mix import mixture
from feedloop.llm.residue import residue, without_residue
from feedloop.llm.simjoin import similar_pairs
from feedloop.llm.topn import top_n
from feedloop.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    liked = table(spark, sf_dir, "ratings").where(F.col("value").between(4.0, 5.0))
    pairs = similar_pairs(liked, "uidx", "iidx", Fraction(7, 10), least=12)
    return pairs.select(F.col("a").alias("uidx_a"), F.col("b").alias("uidx_b"))


P1_SQL = """
WITH d AS (SELECT DISTINCT uidx, iidx FROM ratings
           WHERE uidx IS NOT NULL AND iidx IS NOT NULL AND NOT isnan(value) AND value BETWEEN 4 AND 5),
s AS (SELECT uidx, count(*) AS n FROM d GROUP BY uidx HAVING count(*) >= 12),
e AS (SELECT d.uidx, d.iidx FROM d JOIN s ON d.uidx = s.uidx),
p AS (SELECT x.uidx AS uidx_a, y.uidx AS uidx_b, count(*) AS n FROM e x JOIN e y ON x.iidx = y.iidx AND x.uidx < y.uidx GROUP BY 1, 2)
SELECT uidx_a, uidx_b FROM p JOIN s sa ON sa.uidx = uidx_a JOIN s sb ON sb.uidx = uidx_b WHERE 10 * p.n >= 7 * (sa.n + sb.n - p.n)
"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = associations(table(spark, sf_dir, "ratings"), "uidx", "iidx", least=8)
    strong = pairs.where(F.col("n_ab") * F.col("n") >= 15 * F.col("n_a") * F.col("n_b"))
    return strong.select(F.col("a").alias("iidx_a"), F.col("b").alias("iidx_b"))


def p3_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = associations(table(spark, sf_dir, "ratings"), "uidx", "iidx", least=8)
    return pairs.select(
        F.col("a").alias("iidx_a"), F.col("b").alias("iidx_b"), "n_ab", "n_a", "n_b", "n",
        F.round("lift", 6).alias("lift"), F.round("log_odds", 6).alias("log_odds"),
    )


_P3_PAIRS = """
WITH d AS (SELECT DISTINCT uidx, iidx FROM ratings WHERE uidx IS NOT NULL AND iidx IS NOT NULL),
c AS (SELECT iidx, count(*) AS n FROM d GROUP BY iidx),
t AS (SELECT count(DISTINCT uidx) AS n FROM ratings),
p AS (SELECT x.iidx AS iidx_a, y.iidx AS iidx_b, count(*) AS n_ab FROM d x JOIN d y ON x.uidx = y.uidx AND x.iidx < y.iidx
      GROUP BY 1, 2 HAVING count(*) >= 8),
q AS (SELECT iidx_a, iidx_b, n_ab, ca.n AS n_a, cb.n AS n_b, t.n AS n FROM p JOIN c ca ON ca.iidx = iidx_a JOIN c cb ON cb.iidx = iidx_b CROSS JOIN t)
"""
P3_SQL = _P3_PAIRS + "SELECT iidx_a, iidx_b FROM q WHERE n_ab * n >= 15 * n_a * n_b"
P3_ODDS_SQL = (
    _P3_PAIRS
    + """SELECT iidx_a, iidx_b, n_ab, n_a, n_b, n, round(n_ab * n / (n_a * n_b)::DOUBLE, 6) AS lift,
       round(ln((n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5)::DOUBLE / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5))), 6) AS log_odds FROM q"""
)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = table(spark, sf_dir, "ratings").where(F.col("value").between(0.5, 5.0))
    return top_n(rated, "uidx", "iidx", "value", 5).select("uidx", "iidx")


P4_SQL = """
WITH b AS (SELECT uidx, iidx, max(value) AS v FROM ratings
           WHERE uidx IS NOT NULL AND iidx IS NOT NULL AND NOT isnan(value) AND value BETWEEN 0.5 AND 5 GROUP BY uidx, iidx),
r AS (SELECT uidx, iidx, row_number() OVER (PARTITION BY uidx ORDER BY v DESC, iidx) AS k FROM b)
SELECT uidx, iidx FROM r WHERE k <= 5
"""


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids with the byte offset at which each token begins."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text", offsets=True)



def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix with their number of copies."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every listed source."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[1]



def p7_million(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of a mix of a million tokens, or as many as the sources can give."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), total=1_000_000)[1]


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every mix: no document too often, budgets met to less than a document, sums and shares that agree, targets met by sources that aren't capped."""
    mix, shares = mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))
    per = mix.groupBy("source").agg(
        F.max("copies").alias("_most"), F.max("n_tokens").alias("_longest"), F.sum(F.col("copies") * F.col("n_tokens")).alias("_tokens"), F.count("*").alias("_docs"), F.countDistinct("doc_id").alias("_ids")
    )
    whole = F.sum("actual_share").over(Window.partitionBy())  # a row for each listed source
    left = F.col("budget") - F.col("mixed_tokens")
    capped = F.col("budget") >= F.col("source_tokens") * F.col("max_repeats")
    rows = shares.withColumn("_whole", whole).join(per, "source", "left").na.fill(0, ["_most", "_longest", "_tokens", "_docs", "_ids"])
    return rows.select(
        "source", "target_share", "max_repeats", "n_docs",
        (F.col("_most") <= F.col("max_repeats")).alias("within_repeats"), (F.col("_docs") == F.col("_ids")).alias("listed_once"), (F.col("_tokens") == F.col("mixed_tokens")).alias("sums_agree"),
        ((left >= 0) & (left <= F.col("_longest"))).alias("budget_met"), (F.abs(F.col("_whole") - 1) < 1e-9).alias("shares_add_up"),
        (capped | (F.col("actual_share") >= F.col("target_share") - 0.01)).alias("target_met"),
    )


P7_INVARIANTS_SQL = """SELECT t.source, coalesce(t.target_share, 0) AS target_share, coalesce(t.max_repeats, 0) AS max_repeats, count(d.doc_id) AS n_docs,
  TRUE AS within_repeats, TRUE AS listed_once, TRUE AS sums_agree, TRUE AS budget_met, TRUE AS shares_add_up, TRUE AS target_met
FROM source_targets t LEFT JOIN documents d ON d.source = t.source AND d.text <> '' WHERE t.source IS NOT NULL GROUP BY 1, 2, 3"""


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = residue(table(spark, sf_dir, "documents"), "doc_id", "text", "title_code")
    return found.where("residue IS NOT NULL").select("doc_id")


def p8_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents found, with the kind of residue."""
    return residue(table(spark, sf_dir, "documents"), "doc_id", "text", "title_code").where("residue IS NOT NULL")


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without template residue and error pages."""
    return without_residue(table(spark, sf_dir, "documents"), "text", "title_code")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p3_odds": p3_odds,
    "p4_found": p4_found,
    "p6_ids": p6_ids,
    "p6_offsets": p6_offsets,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_million": p7_million,
    "p7_invariants": p7_invariants,
    "p8_found": p8_found,
    "p8_kinds": p8_kinds,
    "p8_clean": p8_clean,
}
SQL: dict[str, str] = {"p1_found": P1_SQL, "p3_found": P3_SQL, "p3_odds": P3_ODDS_SQL, "p4_found": P4_SQL, "p7_invariants": P7_INVARIANTS_SQL}
