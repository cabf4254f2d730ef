"""Queries of the core's record operators: rows that fail to parse, and keys that hold most rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloop.operators.key_chunks import fields_means, heavy_keys
from feedloop.operators.prefix import sums_before
from feedloop.operators.strict_load import edges, rejects
from feedloop.session import checkpoint_dir, table
from feedloop.sources import text


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects(table(spark, sf_dir, "edge_lines")).select("line_id")


def p2_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(table(spark, sf_dir, "edge_lines"))


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rejected line's id and the reason."""
    return rejects(table(spark, sf_dir, "edge_lines")).select("line_id", "reason")


_ID = '(?:([0-9]+)|"([0-9]+)")'
_NUMBER = r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_LINE = rf"\A{_ID}\t{_ID}\t(?:({_NUMBER})?|\"({_NUMBER})?\")\t{_ID}\r?\z".replace('\\"', '"')
_P2 = f"""
WITH m AS (SELECT line_id, regexp_matches(line, '{_LINE}') AS fits,
  regexp_extract(line, '{_LINE}', 1) || regexp_extract(line, '{_LINE}', 2) AS a,
  regexp_extract(line, '{_LINE}', 3) || regexp_extract(line, '{_LINE}', 4) AS b,
  regexp_extract(line, '{_LINE}', 5) || regexp_extract(line, '{_LINE}', 6) AS w,
  regexp_extract(line, '{_LINE}', 7) || regexp_extract(line, '{_LINE}', 8) AS t FROM edge_lines),
g AS (SELECT line_id, try_cast(a AS BIGINT) AS node_a, try_cast(b AS BIGINT) AS node_b, try_cast(nullif(w, '') AS DOUBLE) AS weight,
  try_cast(t AS INTEGER) AS types, coalesce(fits AND try_cast(a AS BIGINT) IS NOT NULL AND try_cast(b AS BIGINT) IS NOT NULL
  AND try_cast(t AS INTEGER) IS NOT NULL AND (w = '' OR coalesce(isfinite(try_cast(w AS DOUBLE)), FALSE)), FALSE) AS good FROM m)
"""


_FIELD = '(?:"(?:[^"]|"")*"|[^"\\t]*)'
_P2_REASONS = _P2 + f"""
, t AS (SELECT line_id, line, CASE WHEN right(line, 1) = chr(13) THEN left(line, length(line) - 1) ELSE line END AS body FROM edge_lines),
s AS (SELECT *, regexp_matches(body, '(?s)\\A{_FIELD}(?:\\t{_FIELD})*\\z') AS quoted, regexp_extract_all(chr(9) || body, '(?s)\\t({_FIELD})', 1) AS f FROM t),
k AS (SELECT *, list_transform(f, lambda v: CASE WHEN length(v) >= 2 AND left(v, 1) = '"' AND right(v, 1) = '"'
  THEN replace(v[2:length(v) - 1], '""', '"') ELSE v END) AS v FROM s)
SELECT k.line_id, CASE WHEN line IS NULL THEN 'line is null' WHEN body = '' THEN 'line is empty' WHEN NOT quoted THEN 'broken quoting'
  WHEN len(f) <> 4 THEN 'column count ' || len(f) || ', not 4'
  WHEN NOT regexp_full_match(v[1], '[0-9]+') THEN 'nodeA is not digits' WHEN try_cast(v[1] AS BIGINT) IS NULL THEN 'nodeA out of range'
  WHEN NOT regexp_full_match(v[2], '[0-9]+') THEN 'nodeB is not digits' WHEN try_cast(v[2] AS BIGINT) IS NULL THEN 'nodeB out of range'
  WHEN v[3] <> '' AND NOT regexp_full_match(v[3], '{_NUMBER}') THEN 'weight is not a number'
  WHEN v[3] <> '' AND NOT coalesce(isfinite(try_cast(v[3] AS DOUBLE)), FALSE) THEN 'weight is not finite'
  WHEN NOT regexp_full_match(v[4], '[0-9]+') THEN 'types is not digits' ELSE 'types out of range' END AS reason
FROM k JOIN g ON g.line_id = k.line_id WHERE NOT good"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(table(spark, sf_dir, "ratings"), ["iidx", "uidx"], "value", 0.02)


def p5_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count and mean value of every item code and of every user code."""
    rows = fields_means(table(spark, sf_dir, "ratings"), ["iidx", "uidx"], "value")[0]
    return rows.select("field", F.col("code").cast("int").alias("code"), "n_rows", F.round("mean_value", 6).alias("mean_value"))


_P5 = " UNION ALL ".join(
    f"""SELECT '{k}' AS field, {k} AS code, count(*) AS n_rows,
       round(sum(CASE WHEN isnan(value) THEN NULL ELSE value END) / count(CASE WHEN isnan(value) THEN NULL ELSE value END), 6) AS mean_value
       FROM ratings WHERE {k} IS NOT NULL GROUP BY {k}"""
    for k in ("iidx", "uidx")
)

def _written(spark: SparkSession, rows: DataFrame, order: str) -> str:
    """The folder to which lines ``(order, value)`` were written in their order, as several files."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/text-{uuid.uuid4()}"
    rows.repartitionByRange(7, order).sortWithinPartitions(order).select("value").write.text(path)
    return path


def text_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings written as delimited files, and read back in the order of the lines."""
    rows = table(spark, sf_dir, "ratings").where("uidx IS NOT NULL AND iidx IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    path = _written(spark, rows.select("seq", F.concat_ws("::", "uidx", "iidx", "value").alias("value")), "seq")
    back = text.ratings(spark, path)
    return _placed(back).select("place", "user", "item", "rating")


def text_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as tab-separated files, and read back in the order of the lines."""
    rows = table(spark, sf_dir, "replay_log").where("uidx IS NOT NULL AND iidx IS NOT NULL AND reward IS NOT NULL AND NOT isnan(reward)")
    listed = F.transform(F.filter(F.coalesce("cands", F.array().cast("array<int>")), lambda c: c.isNotNull()), lambda c: c.cast("string"))
    line = F.concat_ws("\t", F.col("uidx").cast("string"), F.col("iidx").cast("string"), F.col("reward").cast("string"), F.concat_ws("\t", listed))
    back = text.log(spark, _written(spark, rows.select("seq", F.regexp_replace(line, "\t$", "").alias("value")), "seq"))
    return _placed(back).select("place", "u", "i", "reward", F.sort_array("cands").alias("cands"))


def _placed(rows: DataFrame) -> DataFrame:
    return sums_before(rows.withColumn("_n", F.lit(1)), ["seq"], "_n").withColumn("place", F.col("_before") + 1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_edges": p2_edges,
    "p2_reasons": p2_reasons,
    "p5_found": p5_found,
    "p5_means": p5_means,
    "text_ratings": text_ratings,
    "text_log": text_log,
}
SQL: dict[str, str] = {
    "p2_found": _P2 + "SELECT line_id FROM g WHERE NOT good",
    "p2_edges": _P2 + "SELECT line_id, node_a, node_b, weight, types FROM g WHERE good",
    "p2_reasons": _P2_REASONS,
    "p5_found": f"SELECT field, code FROM ({_P5}) WHERE n_rows > 0.02 * (SELECT count(*) FROM ratings)",
    "p5_means": _P5,
    "text_ratings": """SELECT row_number() OVER (ORDER BY seq) AS place, uidx::BIGINT AS "user", iidx::BIGINT AS item, value AS rating FROM ratings
        WHERE uidx IS NOT NULL AND iidx IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)""",
    "text_log": """SELECT row_number() OVER (ORDER BY seq) AS place, uidx AS u, iidx AS i, reward,
        list_sort(list_distinct(list_append(list_filter(coalesce(cands, []), lambda c: c IS NOT NULL), iidx))) AS cands FROM replay_log
        WHERE uidx IS NOT NULL AND iidx IS NOT NULL AND reward IS NOT NULL AND NOT isnan(reward)""",
}
